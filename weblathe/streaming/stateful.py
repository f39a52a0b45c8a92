"""Structured Streaming forms: windows with watermarks, deduplication, change feeds, and pacing as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weblathe.operators.jobs import PACED, Pacing


def outcome_counts(stream: DataFrame, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Outcomes in tumbling or sliding event-time windows; rows later than the watermark are dropped."""
    span = F.window("completed_at", window, slide) if slide else F.window("completed_at", window)
    counted = stream.withWatermark("completed_at", late).groupBy(span.alias("w"), "outcome").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "outcome", "n")


def scan_sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of scans of a domain with no pause longer than ``gap``."""
    counted = stream.withWatermark("completed_at", late).groupBy("domain", F.session_window("completed_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("domain", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each_run(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Snapshots delivered twice count once; state is dropped behind the watermark."""
    return stream.withWatermark("completed_at", late).dropDuplicatesWithinWatermark(["run_id"])


BUCKETS = 4096


def bucketed(stream: DataFrame, *keys: str) -> DataFrame:
    """``stream`` with the bucket of its keys: a group is a bucket, as a call for each key costs far more than its rows.

    The number of buckets belongs to the checkpoint and can't change with it.
    """
    return stream.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))


def change_feed(stream: DataFrame) -> DataFrame:
    """Each observation (domain, signal, run_id, at, outcome, value_json) against the signal's last one.

    State is one observation for each (domain, signal), those of a bucket as JSON. Within a batch rows are taken by (at, run_id);
    older ones than the state are passed over.
    """
    schema = "domain string, signal string, previous_run_id string, run_id string, previous_outcome string, outcome string, changed boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    columns = ["domain", "signal", "at", "run_id", "outcome", "value_json"]

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f[columns] for f in frames]).sort_values(["at", "run_id"])
        held = {(d, s): tuple(last) for d, s, *last in json.loads(state.get[0])} if state.exists else {}
        out = []
        for domain, signal, at, run, outcome, value in rows.itertuples(index=False):
            now, last = (run, float(at), outcome, value), held.get((domain, signal))
            if last is not None:
                if (now[1], now[0]) <= (last[1], last[0]):
                    continue
                out.append((domain, signal, last[0], run, last[2], outcome, (last[2], last[3]) != (outcome, value)))
            held[domain, signal] = now
        state.update((json.dumps([(*key, *last) for key, last in held.items()]),))
        yield pd.DataFrame(out, columns=names)

    return bucketed(stream, "domain", "signal").groupBy("_bucket").applyInPandasWithState(step, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def paced(stream: DataFrame, **limits) -> DataFrame:
    """Pacing decisions for a stream of events (domain, at, sequence, event, amount); state is five numbers a domain, those of a bucket as JSON."""
    names = [c.split()[0] for c in PACED.split(", ")]
    kept = ("next", "interval", "failures", "circuit", "updated")

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, Pacing] = {}
        for domain, *numbers in json.loads(state.get[0]) if state.exists else ():
            held[domain] = Pacing(**limits)
            for name, value in zip(kept, numbers, strict=True):
                setattr(held[domain], name, value)
        out = []
        rows = pd.concat([f[["domain", "at", "sequence", "event", "amount"]] for f in frames]).sort_values(["at", "sequence"])
        for domain, at, sequence, event, amount in rows.itertuples(index=False):
            pacing = held.setdefault(domain, Pacing(**limits))
            decision, wait = pacing.apply(at, event, None if amount is None or amount != amount else amount)
            out.append((domain, at, sequence, event, decision, wait, pacing.next, pacing.failures, pacing.circuit))
        state.update((json.dumps([(d, *(float(getattr(p, name)) if name != "failures" else int(p.failures) for name in kept)) for d, p in held.items()]),))
        yield pd.DataFrame(out, columns=names)

    return bucketed(stream, "domain").groupBy("_bucket").applyInPandasWithState(step, PACED, "held string", "append", GroupStateTimeout.NoTimeout)
