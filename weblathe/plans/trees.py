"""Queries over snapshot trees: written once though given twice, read strictly, pruned, and with their problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.operators import analysis
from weblathe.plans import corpus, functions, oracle
from weblathe.sources import tree
from weblathe.sources.shared import shared_folder


def written_tree(spark: SparkSession, d: str) -> str:
    """The snapshots of all events, first those of even users, then all, then all again: a replay and an overlap."""
    root = f"{shared_folder(spark)}/tree"
    made = functions.event_snapshots(spark, d)
    tree.write_once(made.where(F.pmod(F.xxhash64("run_id"), F.lit(2)) == 0), root)
    tree.write_once(made, root)
    tree.write_once(made, root)
    return root


def snapshot_tree_runs(spark, d):
    """Every run once, read back by the strict reader."""
    runs = analysis.runs_of_snapshots(tree.load(spark, written_tree(spark, d)))
    return runs.select("run_id", "domain", corpus.stamp(F.col("completed_at")).alias("completed_at"), "http_requests", "browser_requests", "observed", "no_evidence", "skipped", "errors", "probe_errors")


def snapshot_tree_days(spark, d):
    """The runs of ten days and one host: only their folders are opened."""
    found = tree.load(spark, written_tree(spark, d)).where("date >= '2024-01-08' and date < '2024-01-18' and host = 'h1.example'")
    return found.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day"), "host").agg(F.count("*").alias("runs"), F.sum(F.size("observations")).cast("long").alias("observations"))


def snapshot_tree_problems(spark, d):
    """A tree with broken documents in reporting mode: each problem with the days and documents it is in."""
    root = f"{shared_folder(spark)}/tree"
    tree.register(spark)
    rows = tree.documents_of(functions.event_snapshots(spark, d))
    n = F.conv(F.substring(F.md5("run_id"), 1, 6), 16, 10).cast("long")
    broken = (
        F.when(n % 11 == 0, F.concat(F.lit("{"), F.col("document")))
        .when(n % 11 == 1, F.regexp_replace("document", r"^\{", '{"extra":1,'))
        .when(n % 11 == 2, F.regexp_replace("document", '"request_count":[0-9]+', '"request_count":-1'))
        .when(n % 11 == 3, F.regexp_replace("document", '"schema_version":"0.2.0"', '"schema_version":"7"'))
        .otherwise(F.col("document"))
    )
    rows.withColumn("document", broken).repartition("date", "host").sortWithinPartitions("date", "host").write.format(tree.FORMAT).mode("append").option("path", root).save()
    found = tree.load(spark, root, strict=False)
    kind = F.when(F.col("problem").startswith("not JSON"), "not JSON").otherwise(F.col("problem"))
    return found.groupBy(kind.alias("problem")).agg(F.count("*").alias("documents"), F.count_distinct("date").alias("days"), F.count("run_id").alias("readable"))


QUERIES = {f.__name__: f for f in (snapshot_tree_runs, snapshot_tree_days, snapshot_tree_problems)}

RUNS = f"{oracle.OBS}, h as (select run_id, 'h' || (cast(substr(domain, 2) as bigint) % 3) || '.example' as host, completed_at, substr(completed_at, 1, 10) as day, count(*) as n, cast('0x' || substr(md5(run_id), 1, 6) as bigint) % 11 as k from obs group by run_id, domain, completed_at)"
SQL = {
    "snapshot_tree_runs": functions.SQL["snapshots_written_and_read"],
    "snapshot_tree_days": f"with {RUNS} select day, host, count(*) as runs, cast(sum(n) as bigint) as observations from h where day >= '2024-01-08' and day < '2024-01-18' and host = 'h1.example' group by all",
    "snapshot_tree_problems": f"""with {RUNS} select case k when 0 then 'not JSON' when 1 then 'snapshot has unknown fields [''extra'']' when 2 then 'request_count must not be negative' when 3 then 'unsupported schema version' end as problem,
count(*) as documents, count(distinct day) as days, count(*) filter (k > 1) as readable from h group by 1""",
}
