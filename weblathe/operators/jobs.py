"""Batch jobs as tables: claims, guarded transitions, resumption, progress, and pacing as a fold.

jobs: run_id, ordinal, origin, registrable_domain, status, not_before, request_count, attempts, notes.
runs: run_id, status, owner, lease_expires, stop_requested. Statuses: pending, running, completed,
completed_with_notes, deferred, ceased, failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.operators import ranges

STATUSES = ("pending", "running", "completed", "completed_with_notes", "deferred", "ceased", "failed")


def create_jobs(targets: DataFrame) -> DataFrame:
    """Jobs from targets (run_id, position, origin, registrable_domain): the first of each origin, numbered from 0.

    Firsts are combined before the shuffle and numbered over ranges, so a run may have any share of the targets.
    """
    first = targets.groupBy("run_id", "origin").agg(F.min_by(F.struct("position", "registrable_domain"), "position").alias("first")).select("run_id", "origin", "first.*")
    numbered = ranges.running(first, ["run_id"], ["position"], rank="ordinal")
    return numbered.select("run_id", (F.col("ordinal") - 1).cast("int").alias("ordinal"), "origin", "registrable_domain", F.lit("pending").alias("status"))


def claimable(jobs: DataFrame, runs: DataFrame, owner: str, now: Column) -> DataFrame:
    """Pending jobs of runs that ``owner`` leases, whose domain no live run works on: a semi and an anti join.

    The theta condition on the lease is a filter before the joins, which stay equi-joins.
    """
    live = runs.where(F.col("lease_expires") > now)
    busy = jobs.where("status = 'running'").join(live.select("run_id"), "run_id", "left_semi").select("registrable_domain").distinct()
    mine = live.where((F.col("owner") == owner) & ~F.coalesce("stop_requested", F.lit(False))).select("run_id")
    return jobs.where("status = 'pending'").join(mine, "run_id", "left_semi").join(busy, "registrable_domain", "left_anti")


def next_claims(jobs: DataFrame, runs: DataFrame, owner: str, now: Column) -> DataFrame:
    """Of the claimable jobs the first of each domain: one active job for each registrable domain."""
    first = F.row_number().over(Window.partitionBy("registrable_domain").orderBy("run_id", "ordinal"))
    return claimable(jobs, runs, owner, now).withColumn("_n", first).where("_n = 1").drop("_n").withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1})


def apply_results(jobs: DataFrame, runs: DataFrame, results: DataFrame, owner: str, now: Column) -> DataFrame:
    """Guarded transitions: a result (run_id, ordinal, result, requests, not_before, notes) counts only if its job
    still runs under the owner's live lease. Requests add up on completion and deferral; notes are cut at 2,048."""
    mine = runs.where((F.col("owner") == owner) & (F.col("lease_expires") > now)).select("run_id")
    r = results.join(mine, "run_id", "left_semi").select("run_id", "ordinal", F.col("result"), F.col("requests"), F.col("not_before").alias("_until"), F.left("notes", F.lit(2048)).alias("_notes"))
    joined = jobs.join(r, ["run_id", "ordinal"], "left")
    taken = (F.col("status") == "running") & F.col("result").isNotNull()
    counts = taken & F.col("result").isin("completed", "completed_with_notes", "deferred")
    return joined.select(
        "run_id", "ordinal", "origin", "registrable_domain",
        F.when(taken, F.col("result")).otherwise(F.col("status")).alias("status"),
        F.when(taken & (F.col("result") == "deferred"), F.col("_until")).otherwise(F.col("not_before")).alias("not_before"),
        (F.col("request_count") + F.when(counts, F.coalesce("requests", F.lit(0))).otherwise(0)).alias("request_count"),
        "attempts",
        F.when(taken, F.col("_notes")).otherwise(F.col("notes")).alias("notes"),
    )


def resume(jobs: DataFrame, now: Column) -> DataFrame:
    """Running and failed jobs become pending again; deferred ones once their time has come."""
    back = F.col("status").isin("running", "failed") | ((F.col("status") == "deferred") & (F.coalesce("not_before", now) <= now))
    return jobs.withColumn("status", F.when(back, "pending").otherwise(F.col("status")))


def progress(jobs: DataFrame) -> DataFrame:
    """Counts of each run by status, zero-filled, requests, and the finished fraction (1.0 for an empty run)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    done = F.col("completed") + F.col("completed_with_notes") + F.col("ceased") + F.col("failed")
    grouped = jobs.groupBy("run_id").agg(F.count("*").alias("total"), *counts, F.coalesce(F.sum("request_count"), F.lit(0)).cast("long").alias("requests"))
    return grouped.withColumn("fraction_finished", F.when(F.col("total") == 0, 1.0).otherwise(done / F.col("total")))


def progress_lines(progressed: DataFrame) -> DataFrame:
    """One JSON line for each run's progress, keys in alphabetical order."""
    return progressed.select(F.to_json(F.struct(*sorted(progressed.columns))).alias("value"))


def readiness(controls: DataFrame) -> DataFrame:
    """Checks of the control table (name, value): whether the global stop can be read and is not set."""
    found = controls.where("name = 'global_stop'").agg(F.count("*").alias("n"), F.max(F.lower(F.col("value").cast("string"))).alias("v"))
    return found.select((F.col("n") == 1).alias("control_present"), F.coalesce(F.col("v").isin("1", "true"), F.lit(False)).alias("stopped"))


def run_status(progressed: DataFrame, stop: Column) -> DataFrame:
    """stopped over completed_with_errors over completed_with_deferred over completed_with_notes over completed."""
    ladder = (
        F.when(stop & (F.col("pending") + F.col("running") > 0), "stopped")
        .when(F.col("failed") > 0, "completed_with_errors")
        .when(F.col("deferred") > 0, "completed_with_deferred")
        .when(F.col("completed_with_notes") > 0, "completed_with_notes")
        .otherwise("completed")
    )
    return progressed.withColumn("run_status", ladder)


def cease_matches(hosts: DataFrame, ceased: DataFrame) -> DataFrame:
    """Hosts that a cease list (domain) covers, with the longest entry: host suffixes are exploded, so this is an equi-join."""
    parts = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("domain"))
    return suffixes.join(ceased.select("domain").distinct(), "domain").groupBy("host").agg(F.max_by("domain", F.length("domain")).alias("ceased_by"))


class Pacing:
    """The pacing state of one domain and what each event does to it; times in seconds."""

    def __init__(self, base: float = 1.0, threshold: int = 2, cooldown: float = 300.0, max_wait: float = 5.0):
        self.base, self.threshold, self.cooldown, self.max_wait = base, threshold, cooldown, max_wait
        self.next, self.interval, self.failures, self.circuit, self.updated = 0.0, 0.0, 0, 0.0, 0.0

    def apply(self, now: float, event: str, amount: float | None) -> tuple[str, float]:
        """(decision, wait): reserve asks for a slot; interval, success and transient change the state."""
        decision, wait = event, 0.0
        amount = max(0.0, amount or 0.0)
        if event == "reserve":
            if self.circuit > now:
                return "rejected", self.circuit - now
            wait = max(0.0, self.next - now)
            if wait > self.max_wait:
                return "deferred", wait
            self.next = max(now, self.next) + max(self.base, self.interval)
            return "granted", wait
        if event == "interval":
            self.interval = amount
            self.next = now + self.interval
        elif event == "success":
            self.failures, self.circuit = 0, 0.0
        elif event == "transient":
            recent = now - self.updated <= self.cooldown
            self.failures = self.failures + 1 if recent else 1
            blocked = max(self.next, now + amount)
            self.next = blocked
            if self.failures >= self.threshold:
                self.circuit = max(self.circuit, blocked, now + self.cooldown)
                decision = "opened"
        self.updated = now
        return decision, wait


PACED = "domain string, at double, sequence long, event string, decision string, wait double, next_allowed_at double, failures int, circuit_until double"


def pace(events: DataFrame, **limits) -> DataFrame:
    """Fold events (domain, at, sequence, event, amount) in order of (at, sequence) for each domain.

    The fold is sequential by nature. Events are sorted by Spark and streamed: a task holds one
    domain's state, never its events, however many a domain has.
    """
    columns = [c.split()[0] for c in PACED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, state = None, None
        for frame in frames:
            out = []
            for d, at, n, event, amount in frame.itertuples(index=False):
                if state is None or d != domain:
                    domain, state = d, Pacing(**limits)
                decision, wait = state.apply(at, event, None if amount is None or amount != amount else amount)
                out.append((d, at, n, event, decision, wait, state.next, state.failures, state.circuit))
            yield pd.DataFrame(out, columns=columns)

    ordered = events.select("domain", "at", "sequence", "event", "amount").repartition("domain").sortWithinPartitions("domain", "at", "sequence")
    return ordered.mapInPandas(run, PACED)
