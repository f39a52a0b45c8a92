"""Assembly of snapshots from captures, evidence, and small report helpers."""

import pytest
from pyspark.sql import functions as F

from weblathe.functions import text as T
from weblathe.operators import analysis, contracts, detectors, jobs
from weblathe.operators.observe import fetch_evidence, matching_evidence
from weblathe.plans import scan

from .test_detectors import PAGE, ROBOTS, fetch, table


def test_snapshots_from_captures(spark):
    home = table(spark, fetch("a", body=PAGE), fetch("b", body="<p>x"))
    robots = table(spark, fetch("a", body=ROBOTS), fetch("b", 403))
    attempts = spark.createDataFrame([("a", 200), ("a", 429), ("b", 200)], "run_id string, status_code int")
    runs = spark.createDataFrame([("a", "a.example"), ("b", "b.example")], "run_id string, domain string")
    got = {r["run_id"]: r["observations"] for r in scan.assemble({"homepage": home, "robots": robots, "attempts": attempts}, runs).collect()}
    assert got["a"]["metadata.html_title"]["value_json"] == '"A page"' and got["a"]["crawler.http_429_frequency"]["outcome"] == "observed"
    assert got["b"]["human.homepage_accessible"]["outcome"] == "skipped" and len(got["a"]) == 8 + 4 + 24 + 22 + 6 + 3
    with pytest.raises(ValueError, match="twice"):
        scan.assemble({"homepage": home}, runs, (("homepage", detectors.homepage_signals),))


def test_evidence_goes_with_observations(spark):
    rows = table(spark, fetch("a")).withColumn("evidence", fetch_evidence(F.col("final_url"), F.current_timestamp(), F.col("status_code"), F.lit("d"), "homepage"))
    got = detectors.homepage_signals(rows).first()
    assert got["evidence"][0]["source_url"] == "https://site.example/" and got["evidence"][0]["http_status"] == 200
    kept = rows.select(F.size(matching_evidence(F.col("evidence"), F.array(F.lit("other")))).alias("n")).first()["n"]
    assert kept == 0


def test_report_helpers(spark):
    failures = spark.createDataFrame([("t", "boom")], "target string, message string")
    assert analysis.failed_results(failures, contracts.signal_catalog(spark)).count() == 110
    runs = spark.createDataFrame([("a", 3, 1), (None, 0, 0)], "domain string, http_requests int, probe_errors int")
    assert tuple(analysis.run_totals(runs).first()) == (2, 3, 1, 1)
    seen = spark.createDataFrame([("d", "a.x", "observed"), ("d", "a.y", "error")], "domain string, signal string, outcome string")
    chosen = spark.createDataFrame([("d", "s", "g", "b", True)], "domain string, sector string, geography string, popularity_band string, selected boolean")
    assert {r["outcome"]: r["share"] for r in analysis.stratum_shares(seen, chosen).collect()} == {"observed": 0.5, "error": 0.5}
    lines = [r["value"] for r in jobs.progress_lines(spark.createDataFrame([(1, "x")], "b int, a string")).collect()]
    assert lines == ['{"a":"x","b":1}']
    assert tuple(jobs.readiness(spark.createDataFrame([("global_stop", "1")], "name string, value string")).first()) == (True, True)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.distinguished_name(F.array(F.struct(F.lit("CN").alias("key"), F.lit("z").alias("value")), F.struct(F.lit("O").alias("key"), F.lit("y").alias("value"))))) == "CN=z, O=y"
    assert [one(T.is_text_type(F.lit(t))) for t in ("text/html; x", "application/xhtml+xml", "application/json")] == [True, True, False]
