"""Streams that run to their end give what the batch gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weblathe.operators import analysis, jobs
from weblathe.streaming import stateful


@pytest.fixture
def feed(spark, tmp_path):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [("1", "a.example", "s.x", t(1), 1.0, "observed", "1"), ("2", "a.example", "s.x", t(2), 2.0, "observed", "2"), ("2", "a.example", "s.x", t(2), 2.0, "observed", "2"), ("3", "a.example", "s.x", t(9), 9.0, "error", "null"), ("4", "b.example", "s.x", t(3), 3.0, "observed", "1")]
    schema = "run_id string, domain string, signal string, completed_at timestamp, at double, outcome string, value_json string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in")), spark.createDataFrame(rows, schema), tmp_path


def drain(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_windows_and_sessions(spark, feed):
    stream, batch, tmp = feed
    got = drain(stateful.outcome_counts(stream, "6 hours"), tmp, "tumbling", "update")
    want = batch.groupBy(F.window("completed_at", "6 hours").alias("w"), "outcome").count()
    assert {(r["window_start"], r["outcome"], r["n"]) for r in got.collect()} >= {(r["w"]["start"], r["outcome"], r["count"]) for r in want.collect()}
    sessions = drain(stateful.scan_sessions(stream, "2 hours"), tmp, "sessions", "append")
    assert {r["domain"] for r in sessions.collect()} <= {"a.example", "b.example"}


def test_runs_delivered_twice_count_once(feed):
    stream, _, tmp = feed
    got = drain(stateful.first_of_each_run(stream, "12 hours"), tmp, "once")
    assert sorted(r["run_id"] for r in got.collect()) == ["1", "2", "3", "4"]


def test_change_feed_ends_like_the_batch(feed):
    stream, batch, tmp = feed
    got = drain(stateful.change_feed(stream), tmp, "changes").collect()
    assert [(r["previous_run_id"], r["run_id"], r["changed"]) for r in sorted(got, key=lambda r: r["run_id"])] == [("1", "2", True), ("2", "3", True)]
    last = analysis.longitudinal_changes(batch.dropDuplicates()).collect()
    assert [(r["previous_run_id"], r["current_run_id"], r["changed"]) for r in last] == [("2", "3", True)]


def test_paced_stream_equals_the_fold(spark, tmp_path):
    rows = [("a", float(i), i, "transient" if i % 3 == 0 else "reserve", None) for i in range(12)] + [("b", 1.0, 1, "reserve", None)]
    schema = "domain string, at double, sequence long, event string, amount double"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(stateful.paced(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "paced")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.pace(batch).collect()))


def test_state_is_called_for_buckets_not_for_keys(spark, tmp_path):
    schema = "domain string, signal string, run_id string, at double, outcome string, value_json string"
    keys = [(f"d{i}", "s") for i in range(3 * stateful.BUCKETS)]
    for n in range(2):
        spark.createDataFrame([(*k, f"r{n}", float(n), "observed", str(n)) for k in keys], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stateful.change_feed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("bucketed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("bucketed").where("previous_run_id = 'r0' and run_id = 'r1' and changed").count() == len(keys)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= stateful.BUCKETS
