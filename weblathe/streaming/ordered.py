"""Keyed state over event time: rows are taken in order of time, late ones are told apart, idle keys expire.

The rows of a key wait in typed state until the watermark passes them; then a timer takes
them in order of (time, tie) and hands them to a step, however they were spread over batches and files.
A row behind the watermark is not taken: it comes out at once as ``late``, so what was taken, what
still waits and what was late are all rows. What time alone does comes in its place in that order: a key without rows
for ``idle`` milliseconds loses its state and comes out once as ``expired``; a step can ask for other changes (a lease that runs
out, a deferral that ends). Keys share buckets by hash: a bucket has one timer and one value with the states of its keys and few
waiting rows; more wait in parts of spans of time, and those of one span of a bucket are in memory at a time.

Spark keeps such state in RocksDB: ``spark.sql.streaming.stateStore.providerClass`` must name its provider
(``use_rocksdb``); the checkpoint folder holds the state, so a lost executor costs no row.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from weblathe.operators.jobs import Pacing

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Takes each key's rows in order. Subclasses say what a row, and time alone, does to the key's state.

    Keys are dealt to buckets, and a bucket has one value and one timer: calls to the state, not rows, are what costs, and
    many keys share them. Input: the key (as JSON), ``at_ms``, ``tie`` and ``given`` (the rest, as JSON). Output: the key, kind
    (taken, late, woken, expired), at_ms, tie and result (JSON).
    """

    idle_ms: int | None = None
    span_ms: int = 6 * 3_600_000  # how much of a bucket is taken at a time
    few: int = 1024  # so many rows of a bucket wait in its own value, more in parts of spans

    def begin(self) -> dict:
        """The state of a key that is seen for the first time."""
        raise NotImplementedError

    def step(self, key: str, state: dict, at_ms: int, tie: int, given: dict) -> dict | None:
        """Change ``state`` by one row; what comes out of it, None for nothing."""
        raise NotImplementedError

    def next_change(self, state: dict) -> int | None:
        """When the state changes by time alone next, in milliseconds."""
        return None

    def passed(self, key: str, state: dict, at_ms: int) -> Iterator[tuple[int, dict]]:
        """Change ``state`` by all that time alone does until ``at_ms``: (when, what comes out) in order."""
        return iter(())

    def expired(self, state: dict) -> dict:
        """What comes out when an idle key goes."""
        return {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows of spans that are too many for the bucket's own value; each batch adds parts and rewrites none.
        self.waiting = handle.getMapState("waiting", "span long, part long", "rows string")
        # keys: state and last time of each key; rows: few rows that wait; spans: least time and parts of each span in ``waiting``; alarm: the timer that counts
        self.held = handle.getValueState("held", "keys string, rows string, spans string, alarm_ms long")

    def close(self) -> None:
        pass

    def flush(self) -> None:
        """Write what a subclass keeps of its own state while a span is taken."""

    def read(self) -> tuple[dict[str, list], list, dict[int, list], int | None]:
        seen = self.held.get()
        if seen is None:
            return {}, [], {}, None
        return json.loads(seen[0]), json.loads(seen[1]), {int(k): v for k, v in json.loads(seen[2]).items()}, seen[3]

    def keep(self, keys: dict, few: list, spans: dict, alarm: int | None) -> None:
        self.held.update((json.dumps(keys), json.dumps(few), json.dumps(spans), alarm))

    def spilled(self, few: list, spans: dict[int, list]) -> None:
        """Give ``few`` to the parts of their spans."""
        found: dict[int, list] = {}
        for r in few:
            found.setdefault(r[1] // self.span_ms, []).append(r)
        for span, rows in found.items():
            least, first, end = spans.get(span, (None, 0, 0))
            spans[span] = [min(r[1] for r in rows) if least is None else min(least, *(r[1] for r in rows)), first, end + 1]
            self.waiting.updateValue((span, end), (json.dumps(rows),))

    def row(self, key: str, kind: str, at_ms: int, tie: int, result: str) -> Row:
        return OUT(key, kind, at_ms, tie, result)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        keys, few, spans, alarm = self.read()
        first = None
        while part := list(itertools.islice(rows, 4096)):
            for r in part:
                at = r["at_ms"]
                if at <= mark:
                    yield self.row(r["key"], "late", at, r["tie"], r["given"])
                else:
                    few.append([r["key"], at, r["tie"], r["given"]])
                    first = at if first is None else min(first, at)
            if len(few) > self.few:
                self.spilled(few, spans)
                few = []
        if first is None:
            return
        if alarm is None or first < alarm:
            alarm = first
            self.handle.registerTimer(alarm)
        self.keep(keys, few, spans, alarm)

    def until(self, key: str, state: dict | None, last: int | None, at_ms: int, out: list) -> dict | None:
        """The state after all that time alone does to it until ``at_ms``; None once it has gone."""
        if state is None:
            return None
        end = last + self.idle_ms if self.idle_ms else None
        gone = end is not None and end <= at_ms
        out += [(key, "woken", when, -1, json.dumps(result)) for when, result in self.passed(key, state, end if gone else at_ms)]
        if gone:
            out.append((key, "expired", end, -1, json.dumps(self.expired(state))))
        return None if gone else state

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        keys, few, spans, alarm = self.read()
        if alarm != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier timer was set after this one
        near: dict[int, list] = {}
        wait = []
        for r in few:
            near.setdefault(r[1] // self.span_ms, []).append(r) if r[1] <= mark else wait.append(r)
        for span in sorted(near.keys() | {s for s, (least, _, _) in spans.items() if least <= mark}):
            rows = near.get(span, [])
            _, begin, end = spans.pop(span, (None, 0, 0))
            for part in range(begin, end):
                rows += json.loads(self.waiting.getValue((span, part))[0])
                self.waiting.removeKey((span, part))
            out: list = []
            for name, at, tie, given in sorted(rows):
                if at > mark:
                    wait.append([name, at, tie, given])
                    continue
                state, last = keys.get(name, (None, None))
                state = self.until(name, state, last, at, out)
                state = self.begin() if state is None else state
                result = self.step(name, state, at, tie, json.loads(given))
                if result is not None:
                    out.append((name, "taken", at, tie, json.dumps(result)))
                keys[name] = [state, at]
            self.flush()
            yield from (self.row(*r) for r in out)
        out, times = [], []
        for name, (state, last) in [*keys.items()]:
            state = self.until(name, state, last, mark, out)
            if state is None:
                del keys[name]
                continue
            keys[name] = [state, last]
            times += [t for t in (self.next_change(state), last + self.idle_ms if self.idle_ms else None) if t is not None]
        self.flush()
        yield from (self.row(*r) for r in out)
        if len(wait) > self.few:
            self.spilled(wait, spans)
            wait = []
        if not keys and not wait and not spans:
            self.held.clear()
            return
        alarm = min([*times, *(r[1] for r in wait), *(least for least, _, _ in spans.values())], default=None)
        if alarm is not None:
            self.handle.registerTimer(alarm)
        self.keep(keys, wait, spans, alarm)


OUT = Row("key", "kind", "at_ms", "tie", "result")


class Kept:
    """A map state whose values are read once and written once while a span is taken."""

    def __init__(self, state):  # noqa: ANN001
        self.state, self.known, self.changed = state, {}, set()

    def get(self, key: tuple) -> tuple | None:
        if key not in self.known:
            found = self.state.getValue(key)
            self.known[key] = None if found is None else tuple(found)
        return self.known[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """None removes the key."""
        self.known[key] = value
        self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            if self.known[key] is not None:
                self.state.updateValue(key, self.known[key])
            elif self.state.containsKey(key):
                self.state.removeKey(key)
        self.known, self.changed = {}, set()


BUCKETS = 4096


def in_order(rows: DataFrame, keys: dict[str, str], at: str, tie: str, processor: InOrder, late: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` through ``processor``: the columns of ``keys`` (name: type), kind, at_ms, tie, result (JSON).

    ``at`` is the event time, ``late`` how long the watermark waits. The stateful operator gets the time as a number,
    not as the watermarked column: Spark would drop late rows before they could be told apart. Keys share ``buckets``
    by hash; the number belongs to the checkpoint and can't change with it.
    """
    rest = [c for c in rows.columns if c not in (*keys, at, tie)]
    marked = rows.withWatermark(at, late)
    key = F.to_json(F.struct(*(F.col(k).cast(t).alias(k) for k, t in keys.items())))
    plain = marked.select(key.alias("key"), F.unix_millis(at).alias("at_ms"), F.col(tie).cast("long").alias("tie"), F.to_json(F.struct(*rest)).alias("given"))
    dealt = plain.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    out = dealt.groupBy("bucket").transformWithState(processor, StructType.fromDDL("key string, kind string, at_ms long, tie long, result string"), "append", "eventTime")
    named = F.from_json("key", ", ".join(f"`{k}` {t}" for k, t in keys.items()))
    return out.withColumn("key", named).select("key.*", "kind", "at_ms", "tie", "result")


class Changes(InOrder):
    """Each run of a key against the one before it; state is the latest run."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def begin(self) -> dict:
        return {}

    def step(self, key: str, state: dict, at_ms: int, tie: int, given: dict) -> dict | None:
        now = {"run": given.get("run_id"), "outcome": given.get("outcome"), "value": given.get("value_json")}
        before = dict(state)
        state.update(now)
        if not before:
            return None
        changed = (before["outcome"], before["value"]) != (now["outcome"], now["value"])
        return {"previous_run_id": before["run"], "run_id": now["run"], "previous_outcome": before["outcome"], "outcome": now["outcome"], "changed": changed}

    def expired(self, state: dict) -> dict:
        return {"previous_run_id": state["run"], "previous_outcome": state["outcome"]}


class PacedKey(InOrder):
    """Pacing of a domain; state is five numbers. An idle domain starts afresh."""

    def __init__(self, idle_ms: int | None = None, **limits: float):
        self.idle_ms, self.limits = idle_ms, limits

    def begin(self) -> dict:
        return {"next": 0.0, "interval": 0.0, "failures": 0, "circuit": 0.0, "updated": 0.0}

    def step(self, key: str, state: dict, at_ms: int, tie: int, given: dict) -> dict:
        pacing = Pacing(**self.limits)
        for name, value in state.items():
            setattr(pacing, name, value)
        decision, wait = pacing.apply(at_ms / 1000, given["event"], given.get("amount"))
        state.update({name: getattr(pacing, name) for name in state})
        return {"event": given["event"], "decision": decision, "wait": wait, "next_allowed_at": pacing.next, "failures": pacing.failures, "circuit_until": pacing.circuit}


class Leases(InOrder):
    """A run's lease and jobs. A lease that nobody renews runs out by itself and frees the jobs that ran under it;
    a deferred job is pending again when its time has come. Jobs are state of their own, not part of the run's.

    Events: acquire, renew, release (owner); claim, complete, defer (owner, job; defer: until_ms); stop.
    """

    def __init__(self, lease_ms: int = 60_000):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.jobs = Kept(handle.getMapState("jobs", "run string, job string", "status string, until_ms long"))
        self.due = Kept(handle.getMapState("due", "run string, until_ms long", "jobs string"))
        self.running = Kept(handle.getMapState("running", "run string", "jobs string"))

    def flush(self) -> None:
        for kept in (self.jobs, self.due, self.running):
            kept.flush()

    def run(self, key: str) -> list[str]:
        """The jobs that run under a lease."""
        found = self.running.get((key,))
        return json.loads(found[0]) if found is not None else []

    def set_run(self, key: str, jobs: set[str]) -> None:
        self.running.put((key,), (json.dumps(sorted(jobs)),) if jobs else None)

    def begin(self) -> dict:
        return {"owner": None, "until": 0, "stopped": False, "due": []}

    def next_change(self, state: dict) -> int | None:
        return min((t for t in (state["until"] if state["owner"] is not None else None, *state["due"][:1]) if t is not None), default=None)

    def passed(self, key: str, state: dict, at_ms: int) -> Iterator[tuple[int, dict]]:
        while (when := self.next_change(state)) is not None and when <= at_ms:
            if state["owner"] is not None and state["until"] == when:
                freed = sorted(self.run(key))
                self.set_run(key, set())
                for job in freed:
                    self.jobs.put((key, job), ("pending", None))
                yield when, {"event": "lease_expired", "owner": state["owner"], "granted": True, "jobs": freed}
                state["owner"] = None
            if state["due"][:1] == [when]:
                named = json.loads(self.due.get((key, when))[0])
                jobs = [job for job in named if self.jobs.get((key, job)) == ("deferred", when)]
                for job in jobs:
                    self.jobs.put((key, job), ("pending", None))
                self.due.put((key, when), None)
                del state["due"][0]
                if jobs:
                    yield when, {"event": "deferral_over", "owner": None, "granted": True, "jobs": sorted(jobs)}

    def step(self, key: str, state: dict, at_ms: int, tie: int, given: dict) -> dict:
        event, owner, job = given["event"], given.get("owner"), given.get("job")
        mine = state["owner"] is not None and state["owner"] == owner
        known = self.jobs.get((key, job)) if job is not None else None
        status = known[0] if known is not None else "pending"
        if event == "acquire":
            granted = state["owner"] is None or mine
        elif event == "stop":
            granted = True
        elif event == "claim":
            granted = mine and not state["stopped"] and status == "pending"
        elif event in ("complete", "defer"):
            granted = mine and status == "running"
        else:
            granted = mine
        if granted and event in ("acquire", "renew"):
            state["owner"], state["until"] = owner, at_ms + self.lease_ms
        elif granted and event == "release":
            state["owner"] = None
        elif granted and event == "stop":
            state["stopped"] = True
        elif granted and event == "claim":
            self.jobs.put((key, job), ("running", None))
            self.set_run(key, {*self.run(key), job})
        elif granted:
            until = given.get("until_ms") if event == "defer" else None
            self.set_run(key, {*self.run(key)} - {job})
            self.jobs.put((key, job), ("completed" if event == "complete" else "deferred", until))
            if until is not None and until <= at_ms:
                self.jobs.put((key, job), ("pending", None))
            elif until is not None:
                others = self.due.get((key, until))
                state["due"] = sorted({*state["due"], until})
                self.due.put((key, until), (json.dumps(sorted({*(json.loads(others[0]) if others is not None else ()), job})),))
        return {"event": event, "owner": owner, "granted": granted, "jobs": [job] if job is not None else []}


CHANGED = "previous_run_id string, run_id string, previous_outcome string, outcome string, changed boolean"
DECIDED = "event string, decision string, wait double, next_allowed_at double, failures int, circuit_until double"


LEASED = "event string, owner string, granted boolean, jobs array<string>"


def opened(found: DataFrame, schema: str) -> DataFrame:
    """The result of the rows of ``in_order`` as columns."""
    return found.withColumn("r", F.from_json("result", schema)).select(*(c for c in found.columns if c != "result"), "r.*")


def change_feed(rows: DataFrame, late: str, idle_ms: int | None = None) -> DataFrame:
    """Observations (domain, signal, completed_at, sequence, run_id, outcome, value_json) against the ones before them."""
    found = in_order(rows, {"domain": "string", "signal": "string"}, "completed_at", "sequence", Changes(idle_ms), late)
    return opened(found, CHANGED)


def paced(rows: DataFrame, late: str, idle_ms: int | None = None, **limits: float) -> DataFrame:
    """Pacing decisions for events (domain, at, sequence, event, amount)."""
    return opened(in_order(rows, {"domain": "string"}, "at", "sequence", PacedKey(idle_ms, **limits), late), DECIDED)


def leases(rows: DataFrame, late: str, lease_ms: int = 60_000) -> DataFrame:
    """What each event (run_id, at, sequence, event, owner, job, until_ms) did, leases that ran out and deferrals that ended."""
    return opened(in_order(rows, {"run_id": "string"}, "at", "sequence", Leases(lease_ms), late), LEASED)


def divided(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that were taken (with what time alone did), and the late ones. With what still waits they are all rows."""
    return found.where("kind <> 'late'"), found.where("kind = 'late'")
