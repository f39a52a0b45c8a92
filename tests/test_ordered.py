"""Keyed state over event time: order, late rows, idle keys, leases and deferrals by timers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weblathe.operators import jobs
from weblathe.plans.streams import drained_in_parts, run_to_end
from weblathe.streaming import ordered

HOUR = 3_600_000


def t(hours):
    return dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hours)


def ms(hours):
    return int(t(hours).timestamp() * 1000)


@pytest.fixture(autouse=True)
def rocks(spark):
    ordered.use_rocksdb(spark)


def observations(spark, rows):
    """rows: (part, domain, hours, outcome)."""
    data = [(p, d, "s", t(h), i, f"r{i}", o, "null") for i, (p, d, h, o) in enumerate(rows)]
    return spark.createDataFrame(data, "part int, domain string, signal string, completed_at timestamp, sequence long, run_id string, outcome string, value_json string")


def test_rows_of_all_parts_are_taken_in_order_and_late_ones_told_apart(spark):
    rows = observations(spark, [(0, "a", 5, "observed"), (0, "a", 1, "error"), (1, "a", 3, "observed"), (1, "a", 6, "error"), (1, "b", 30, "observed"), (2, "a", 10, "observed"), (2, "b", 29, "error"), (2, "b", 60, "error")])
    got = drained_in_parts(rows, "part", 3, lambda s: ordered.change_feed(s, "4 hours")).collect()
    taken = [(r["domain"], r["previous_run_id"], r["run_id"], r["changed"]) for r in sorted(got, key=lambda r: (r["domain"], r["at_ms"])) if r["kind"] == "taken"]
    # Part 0 leaves the mark at 1 h, part 1 at 26 h: the row of 10 h is late, the one of 3 h isn't, the one of 60 h waits.
    assert taken == [("a", "r1", "r2", True), ("a", "r2", "r0", False), ("a", "r0", "r3", True), ("b", "r6", "r4", True)]
    assert [(r["domain"], r["at_ms"], r["run_id"], r["outcome"]) for r in got if r["kind"] == "late"] == [("a", ms(10), "r5", "observed")]
    taken_df, late_df = ordered.divided(spark.createDataFrame(got))
    assert (taken_df.count(), late_df.count()) == (4, 1)


def test_idle_keys_go_and_start_afresh(spark):
    rows = observations(spark, [(0, "a", 1, "observed"), (0, "a", 2, "error"), (0, "a", 40, "error"), (0, "z", 90, "error"), (1, "z", 95, "error")])
    got = drained_in_parts(rows, "part", 2, lambda s: ordered.change_feed(s, "1 hour", 24 * HOUR)).collect()
    seen = sorted((r["domain"], r["kind"], r["at_ms"], r["previous_run_id"], r["run_id"]) for r in got)
    assert seen == [("a", "expired", ms(26), "r1", None), ("a", "expired", ms(64), "r2", None), ("a", "taken", ms(2), "r0", "r1")]


def test_paced_stream_equals_the_fold_over_all_parts(spark):
    data = [(i % 3, f"d{i % 4}", t(i * 0.01 + (i % 3)), i, ["transient", "reserve", "reserve", "success", "interval"][i % 5], float(i % 7) if i % 5 in (0, 4) else None) for i in range(200)]
    rows = spark.createDataFrame(data + [(2, "end", t(99), 999, "reserve", None)], "part int, domain string, at timestamp, sequence long, event string, amount double")
    got = drained_in_parts(rows, "part", 3, lambda s: ordered.paced(s, "12 hours", cooldown=900.0)).where("kind = 'taken'")
    batch = jobs.pace(rows.where("domain <> 'end'").withColumn("at", F.unix_millis("at") / 1000), cooldown=900.0)
    columns = ("domain", "event", "decision", "wait", "next_allowed_at", "failures", "circuit_until")
    assert sorted(tuple(r[c] for c in ("tie", *columns)) for r in got.collect()) == sorted(tuple(r[c] for c in ("sequence", *columns)) for r in batch.collect())


def test_leases_run_out_and_deferrals_end_by_themselves(spark):
    events = [
        (0, 0.0, "acquire", "x", None, None), (0, 0.1, "claim", "x", "j1", None), (0, 0.2, "claim", "y", "j2", None), (0, 0.3, "claim", "x", "j2", None), (0, 0.4, "complete", "x", "j2", None),
        (0, 1.5, "acquire", "y", None, None), (0, 1.6, "claim", "y", "j1", None), (0, 1.7, "defer", "y", "j1", 4.0), (0, 1.8, "claim", "y", "j1", None), (0, 2.3, "renew", "y", None, None), (0, 3.2, "renew", "y", None, None),
        (1, 4.1, "claim", "y", "j1", None), (1, 4.15, "stop", None, None, None), (1, 4.18, "claim", "y", "j3", None), (1, 9.0, "renew", "y", None, None), (1, 50.0, "stop", None, None, None),
    ]
    data = [(p, "r", t(h), i, e, o, j, None if u is None else ms(u)) for i, (p, h, e, o, j, u) in enumerate(events)]
    rows = spark.createDataFrame(data, "part int, run_id string, at timestamp, sequence long, event string, owner string, job string, until_ms long")
    got = sorted(drained_in_parts(rows, "part", 2, lambda s: ordered.leases(s, "2 hours", HOUR)).collect(), key=lambda r: (r["at_ms"], r["tie"]))
    granted = {r["tie"]: r["granted"] for r in got if r["kind"] == "taken"}
    assert granted == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True, 6: True, 7: True, 8: False, 9: True, 10: True, 11: True, 12: True, 13: False, 14: False}
    woken = [(r["at_ms"], r["event"], r["owner"], r["jobs"]) for r in got if r["kind"] == "woken"]
    # x ran out with j1 running; the deferral of j1 ended; y ran out an hour after its last renewal with j1 running again
    assert woken == [(ms(1.0), "lease_expired", "x", ["j1"]), (ms(4.0), "deferral_over", None, ["j1"]), (ms(4.2), "lease_expired", "y", ["j1"])]


def test_a_batch_that_is_written_again_counts_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    run_to_end(stream(), "append", str(tmp_path))
    for commit in (tmp_path / "state" / "commits").iterdir():  # as if the driver had died before it noted the commit
        commit.unlink()
    run_to_end(stream(), "append", str(tmp_path))
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).count() == 5


class Store:
    """Stands for the state of one bucket; counts the calls and the bytes written."""

    def __init__(self):
        self.maps, self.value, self.timers, self.calls, self.written = {}, None, set(), 0, 0

    def getMapState(self, name, *_):  # noqa: N802
        return self if name == "waiting" else None

    def getValueState(self, *_):  # noqa: N802
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.value

            def update(self, value):
                store.calls, store.value = store.calls + 1, value

            def clear(self):
                store.calls, store.value = store.calls + 1, None

        return Value()

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.maps[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls, self.written, self.maps[key] = self.calls + 1, self.written + len(value[0]), value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.maps[key]

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def given(key, at, tie):
    return {"key": key, "at_ms": at, "tie": tie, "given": f'{{"run_id":"r{tie}","outcome":"o{tie % 2}","value_json":"null"}}'}


def test_keys_of_a_bucket_share_the_calls_to_the_state():
    store, changes = Store(), ordered.Changes(3 * 24 * HOUR)
    changes.init(store)
    rows = [given(f"k{i % 300}", 1 + i * HOUR // 10, i) for i in range(900)]
    assert list(changes.handleInputRows((0,), iter(rows), Now(0))) == []
    out = list(changes.handleExpiredTimer((0,), Now(91 * HOUR), Now(min(store.timers))))
    assert [r["kind"] for r in out].count("taken") == 600 and store.calls <= 4


def test_a_hot_key_rewrites_no_rows_that_wait():
    store, changes = Store(), ordered.Changes()
    changes.init(store)
    rows = [given("k", 1 + (i * 7919) % 50_000 * HOUR // 1000, i) for i in range(50_000)]
    for at in range(0, 50_000, 5_000):
        assert list(changes.handleInputRows((0,), iter(rows[at : at + 5_000]), Now(0))) == []
    assert store.written < 1.2 * sum(len(r["given"]) + 40 for r in rows)
    out = list(changes.handleExpiredTimer((0,), Now(60 * HOUR), Now(min(store.timers))))
    assert [r["at_ms"] for r in out] == sorted(r["at_ms"] for r in rows)[1:] and not store.maps
