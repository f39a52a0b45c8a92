"""Snapshots: one JSON document for each (domain, scan), read strictly, migrated, validated, written."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions.parsing import TEXT, in_pieces, record
from weblathe.functions.vocabulary import CONFIDENCES, OUTCOMES

EVIDENCE = "array<struct<source_url: string, observed_at: timestamp, http_status: int, content_sha256: string, note: string>>"
OBSERVATION = f"struct<value_json: string, outcome: string, confidence: string, confidence_score: double, method: string, evidence: {EVIDENCE}>"
REQUEST = "struct<requested_url: string, final_url: string, started_at: timestamp, elapsed_ms: double, status_code: int, response_bytes: bigint, response_truncated: boolean, content_sha256: string, error: string>"
SNAPSHOT = f"""schema_version string, run_id string, domain string, origin string, started_at timestamp, completed_at timestamp, collector_version string, request_count int,
observations map<string, {OBSERVATION}>, requests array<{REQUEST}>, errors array<struct<probe: string, message: string>>"""
VERSION = "0.2.0"
# The fields of each object; * marks those that may be missing.
FIELDS = {
    "snapshot": ("schema_version", "run_id", "domain", "origin", "started_at", "completed_at", "collector_version", "request_count", "observations", "requests", "errors*"),
    "observation": ("value", "outcome", "confidence", "confidence_score", "method", "evidence*"),
    "evidence": ("source_url", "observed_at", "http_status*", "content_sha256*", "note*"),
    "request": ("requested_url", "final_url*", "started_at", "elapsed_ms", "status_code*", "response_bytes", "response_truncated*", "content_sha256*", "error*"),
    "error": ("probe", "message"),
}
OUTCOME_OF = {"confirmed": "observed", "likely": "observed", "possible": "observed", "no_evidence": "no_evidence", "unknown": "error"}


def key_problem(kind: str, value) -> str | None:
    """What is wrong with the keys of an object, None if nothing."""
    if not isinstance(value, dict):
        return f"{kind} must be an object"
    names = {f.rstrip("*") for f in FIELDS[kind]}
    if extra := sorted(value.keys() - names):
        return f"{kind} has unknown fields {extra}"
    if missing := sorted({f for f in FIELDS[kind] if not f.endswith("*")} - value.keys()):
        return f"{kind} lacks {missing}"
    return None


def normal_form(text: str) -> tuple[str | None, str | None]:
    """(normalised JSON, problem): version 0.1.0 gets its outcomes, values become canonical JSON text, key sets are checked."""
    try:
        doc = json.loads(text)
    except ValueError as e:
        return None, f"not JSON: {e}"
    if not isinstance(doc, dict):
        return None, "the document is no JSON object"
    observations = doc.get("observations")
    if not isinstance(observations, dict):
        return None, "observations must be an object"
    if doc.get("schema_version") == "0.1.0":
        for o in observations.values():
            if not isinstance(o, dict) or o.get("confidence") not in OUTCOME_OF:
                return None, "a 0.1.0 observation has no confidence that tells its outcome"
            o["outcome"] = OUTCOME_OF[o["confidence"]]
        doc["schema_version"] = VERSION
    problems = [key_problem("snapshot", doc)]
    for o in observations.values():
        problems.append(key_problem("observation", o))
        if isinstance(o, dict):
            problems += [key_problem("evidence", e) for e in o.get("evidence", [])]
            o["value_json"] = json.dumps(o.pop("value", None), sort_keys=True, separators=(",", ":"))
            o.setdefault("evidence", [])
    problems += [key_problem("request", r) for r in doc.get("requests", [])] + [key_problem("error", e) for e in doc.get("errors", [])]
    doc.setdefault("errors", [])
    problem = next((p for p in problems if p), None)
    return (None, problem) if problem else (json.dumps(doc), None)


NORMALISED = record(json=TEXT, problem=TEXT)


@F.arrow_udf(NORMALISED)
def normalised(text: pa.Array) -> pa.Array:
    return in_pieces(lambda t: dict(zip(("json", "problem"), normal_form(t) if t is not None else (None, None), strict=True)), NORMALISED, text)


# So that a filter on the problem isn't pushed below the parser: that would parse every document twice, in two workers a task.
normalised = normalised.asNondeterministic()


def problems(snapshot: Column) -> Column:
    """What breaks the contract of a parsed snapshot, null if nothing."""
    values = F.map_values(snapshot["observations"])
    fits = lambda o: (
        ((o["outcome"] == "observed") & o["confidence"].isin("confirmed", "likely", "possible")) | ((o["outcome"] == "no_evidence") & (o["confidence"] == "no_evidence")) | (o["outcome"].isin("skipped", "error") & (o["confidence"] == "unknown"))
    )
    every = lambda test: F.coalesce(F.forall(values, lambda o: F.coalesce(test(o), F.lit(False))), F.lit(False))
    return (
        F.when(snapshot["schema_version"] != VERSION, "unsupported schema version")
        .when(~every(lambda o: o["outcome"].isin(*OUTCOMES)), "unknown outcome")
        .when(~every(lambda o: o["confidence"].isin(*CONFIDENCES)), "unknown confidence")
        .when(~every(lambda o: (o["confidence_score"] >= 0) & (o["confidence_score"] <= 1)), "confidence_score out of range")
        .when(~every(fits), "outcome and confidence disagree")
        .when(snapshot["request_count"].isNull() | (snapshot["request_count"] < 0), "request_count must not be negative")
        .when(snapshot["started_at"].isNull() | snapshot["completed_at"].isNull(), "times must be given")
        .when(F.exists(F.coalesce(snapshot["requests"], F.array().cast(f"array<{REQUEST}>")), lambda r: (r["elapsed_ms"] < 0) | (r["response_bytes"] < 0)), "negative request measure")
    )


def parse_snapshots(texts: DataFrame) -> DataFrame:
    """From (path, text): path, problem (null if fine) and the snapshot's columns."""
    rows = texts.withColumn("n", normalised("text")).withColumn("s", F.from_json("n.json", SNAPSHOT))
    return rows.select("path", F.coalesce("n.problem", problems(F.col("s"))).alias("problem"), "s.*")


def snapshot_problem(text: Column) -> Column:
    """What is wrong with a snapshot's text, null if nothing."""
    normal = normalised(text)
    return F.coalesce(normal["problem"], problems(F.from_json(normal["json"], SNAPSHOT)))


def read_snapshots(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """All *.json below ``root``. Strict: the first bad file fails the job, with its path, and so does a root without files;
    else bad files come with a problem.

    ``input_file_name`` gives the path; files are read whole, each in one row, in parallel.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    if strict and files.isEmpty():
        raise ValueError(f"no snapshots below {root}")
    parsed = parse_snapshots(files.select(F.input_file_name().alias("path"), F.col("value").alias("text")))
    if not strict:
        return parsed
    failed = F.raise_error(F.concat(F.lit("invalid snapshot "), F.col("path"), F.lit(": "), F.col("problem")))
    checked = parsed.withColumn("run_id", F.when(F.col("problem").isNotNull(), failed.cast("string")).otherwise(F.col("run_id")))
    return checked.where("run_id is not null").drop("problem", "path")


def write_snapshots(snapshots: DataFrame, root: str) -> None:
    """Append snapshots as JSON, one folder for each day and domain; files of earlier scans are never touched.

    Rows are dealt by the folder's name first, so a folder gets few files.
    """
    value = F.struct("schema_version", "run_id", "domain", "origin", "started_at", "completed_at", "collector_version", "request_count", "observations", "requests", "errors")
    rows = snapshots.select(F.to_date("completed_at").alias("date"), F.regexp_replace("domain", ":", "_").alias("host"), F.to_json(value).alias("value"))
    rows.repartition("date", "host").write.partitionBy("date", "host").mode("append").text(root)


def request_rows(snapshots: DataFrame) -> DataFrame:
    """One row for each HTTP attempt."""
    return snapshots.select("run_id", "domain", F.inline("requests"))
