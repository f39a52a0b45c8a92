"""Building blocks of detectors: an observation as a Column, and the rules for missing input.

A detector maps captured rows to observations. An observation is a struct (signal, outcome,
confidence, confidence_score, value_json, method). Absence (no_evidence), a step that wasn't taken
(skipped) and a failure (error) stay apart from each other and from observed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBSERVATION = "struct<signal: string, outcome: string, confidence: string, confidence_score: double, value_json: string, method: string>"


def scalar_json(value: Column) -> Column:
    """A scalar as JSON; null as null."""
    text = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def nested_json(value: Column) -> Column:
    """An array, map or struct (fields in alphabetical order) as JSON, nulls kept."""
    return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null"))


def observe(signal: str, value_json: Column, confidence, score, method, outcome=None) -> Column:
    """One observation. The outcome follows from the confidence unless given."""
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    derived = F.when(sure == "no_evidence", "no_evidence").when(sure == "unknown", "error").otherwise("observed")
    given = derived if outcome is None else F.coalesce(outcome if isinstance(outcome, Column) else F.lit(outcome), derived)
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(signal).alias("signal"), given.alias("outcome"), sure.alias("confidence"), value(score).cast("double").alias("confidence_score"), value_json.alias("value_json"), value(method).alias("method"))


def seen(signal: str, found: Column, value_json: Column, method, confidence: str = "confirmed", score: float = 1.0, absent: str | None = None) -> Column:
    """Observed where ``found``; otherwise no evidence with score 1. ``absent`` is the value then (default: as given)."""
    there = F.coalesce(found, F.lit(False))
    value = value_json if absent is None else F.when(there, value_json).otherwise(F.lit(absent))
    return observe(signal, value, F.when(there, confidence).otherwise("no_evidence"), F.when(there, score).otherwise(1.0), method)


def text_value(signal: str, value: Column, method: str) -> Column:
    return seen(signal, value.isNotNull(), scalar_json(value), method)


def list_value(signal: str, values: Column, method: str, confidence: str = "confirmed", score: float = 1.0, absent: str | None = None) -> Column:
    return seen(signal, F.size(values) > 0, nested_json(values), method, confidence, score, absent)


def certain(signal: str, value_json: Column, method) -> Column:
    return observe(signal, value_json, "confirmed", 1.0, method)


def inconclusive(o: Column, when: Column, method: str, outcome="error", only_absent: bool = True) -> Column:
    """``o`` replaced by an unknown where ``when`` holds; by default only absences, positives stand."""
    replace = F.coalesce(when, F.lit(False))
    kind = outcome if isinstance(outcome, Column) else F.lit(outcome)

    def judge(x: Column) -> Column:
        unknown = F.struct(x["signal"].alias("signal"), kind.alias("outcome"), F.lit("unknown").alias("confidence"), F.lit(0.0).alias("confidence_score"), F.lit("null").alias("value_json"), F.lit(method).alias("method"))
        return F.when(replace & (x["outcome"] == "no_evidence") if only_absent else replace, unknown).otherwise(x)

    # A lambda on an array of one, so that the observation's expression isn't copied.
    return F.element_at(F.transform(F.array(o), judge), 1)


def unless(missing: Column, method: str, outcome) -> Callable[[Column], Column]:
    """A judge for ``emit``: every observation is unknown where ``missing`` holds."""
    gone = F.coalesce(missing, F.lit(False))
    kind = outcome if isinstance(outcome, Column) else F.lit(outcome)

    def judge(x: Column) -> Column:
        unknown = F.struct(x["signal"].alias("signal"), kind.alias("outcome"), F.lit("unknown").alias("confidence"), F.lit(0.0).alias("confidence_score"), F.lit("null").alias("value_json"), F.lit(method).alias("method"))
        return F.when(gone, unknown).otherwise(x)

    return judge


def emit(rows: DataFrame, *observations: Column, judge: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each observation of each input row, with the row's ``evidence`` if it has some: narrow, no shuffle.

    ``judge`` changes each observation; it is one lambda on the array, so no expression is copied.
    """
    kept = ["run_id", *(c for c in ("evidence",) if c in rows.columns)]
    all_of = F.array(*observations)
    return rows.select(*kept, F.inline(F.transform(all_of, judge) if judge else all_of))


EVIDENCE = "array<struct<source_url: string, observed_at: timestamp, http_status: int, content_sha256: string, note: string>>"


def fetch_evidence(source_url: Column, observed_at: Column, status: Column, digest: Column, note: str | None = None) -> Column:
    """One piece of evidence: where, when, status and digest of what was read."""
    piece = F.struct(source_url.alias("source_url"), observed_at.alias("observed_at"), status.cast("int").alias("http_status"), digest.alias("content_sha256"), F.lit(note).cast("string").alias("note"))
    return F.array(piece).cast(EVIDENCE)


def request_evidence(requests: Column, note: str | None = None) -> Column:
    """Evidence of each attempt in an array of requests; the address is the last one it reached."""
    piece = lambda r: F.struct(F.coalesce(r["final_url"], r["requested_url"]).alias("source_url"), r["started_at"].alias("observed_at"), r["status_code"].cast("int").alias("http_status"), r["content_sha256"].alias("content_sha256"), F.lit(note).cast("string").alias("note"))
    return F.transform(requests, piece).cast(EVIDENCE)


def matching_evidence(evidence: Column, source_urls: Column) -> Column:
    """The evidence from any of the given addresses."""
    return F.filter(evidence, lambda e: F.array_contains(source_urls, e["source_url"]))


def missing_page(status: Column, error: Column, allowed: Column) -> Column:
    """Why there is no page to read: skipped if robots didn't allow it or the response wasn't a page, else error."""
    return F.when(~F.coalesce(allowed, F.lit(False)), "skipped").when(error.isNull() & status.isNotNull(), "skipped").otherwise("error")


def snapshots_of(observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Observations of all detectors gathered into one map for each run; a signal given twice fails the job."""
    fields = ["value_json", "outcome", "confidence", "confidence_score", "method", *(c for c in ("evidence",) if c in observations.columns)]
    gathered = observations.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct(*fields)))).alias("observations"))
    return runs.join(gathered, "run_id", "left")
