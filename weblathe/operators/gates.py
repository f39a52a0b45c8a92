"""Request gates and retries over logs of requests: running caps as windows, order-dependent rules as folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.functions.urls import host_of, same_site
from weblathe.operators.jobs import Pacing

# Default limits.
REQUEST_CAP, THIRD_PARTY_CAP, BYTE_CAP = 30, 10, 10_000_000
RESPONSE_CAP, WALL_SECONDS = 2_000_000, 20.0
REDIRECT_CAP, RETRY_CAP, REQUEST_BUDGET, MAX_WAIT = 5, 1, 8, 5.0
TRANSIENT, REDIRECTS = (429, 503), (301, 302, 303, 307, 308)
# Headers that a repeat request may carry.
CONDITIONAL_HEADERS = ("if-none-match", "if-modified-since")


def conditional_header_ok(name: Column, value: Column) -> Column:
    """Only the two validators, at most 4,096 characters, no control characters."""
    return F.lower(name).isin(*CONDITIONAL_HEADERS) & (F.length(value) <= 4096) & ~value.rlike(r"[\x00-\x1f\x7f]")


def folded(rows: DataFrame, key: str, order: list[str], schema: str, begin: Callable[[], dict], step: Callable[[dict, tuple], tuple]) -> DataFrame:
    """Rows of each key in order through ``step(state, row)``, which changes the state and gives the row that comes out.

    Sequential by nature: Spark deals by key and sorts, a task streams and holds one key's state, never its rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if state is None or getattr(r, key) != current:
                    current, state = getattr(r, key), begin()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def byte_caps(responses: DataFrame, cap: int = BYTE_CAP, response_cap: int = RESPONSE_CAP) -> DataFrame:
    """Chunks of responses (run_id, n, response, bytes) in order: whether each is within the caps of its response and of its run.

    A chunk that is refused adds to neither total, so what comes after it may still fit. State: a total for each response of the run.
    """

    def step(state: dict, r: tuple) -> tuple:
        own = state["of"].get(r.response, 0) + r.bytes
        decision = "negative" if r.bytes < 0 else "response_cap" if own > response_cap else "total_cap" if state["total"] + r.bytes > cap else "accepted"
        if decision == "accepted":
            state["of"][r.response], state["total"] = own, state["total"] + r.bytes
        return r.run_id, r.n, r.response, r.bytes, decision, state["total"], decision == "accepted"

    rows = responses.select("run_id", F.col("n").cast("long").alias("n"), F.col("response").cast("string").alias("response"), F.col("bytes").cast("long").alias("bytes"))
    schema = f"run_id {rows.schema['run_id'].dataType.simpleString()}, n long, response string, bytes long, decision string, total_bytes long, within_cap boolean"
    return folded(rows, "run_id", ["n"], schema, lambda: {"of": {}, "total": 0}, step)


def browser_gate(requests: DataFrame, request_cap: int = REQUEST_CAP, third_party_cap: int = THIRD_PARTY_CAP, wall_seconds: float = WALL_SECONDS) -> DataFrame:
    """Decides each request (run_id, n, origin, url, top_level, permitted, public, elapsed) in order.

    Checks come in this order: time, request cap, the collection's own policy (``permitted``), navigation to
    another site, third-party cap. What passes is reserved and counts; if its address then isn't ``public``, the reservation is
    taken back. So a decision depends on earlier ones: a fold over two counters.
    """
    third = ~same_site(host_of(F.col("url")), host_of(F.col("origin")))
    given = lambda c, kind, other: F.coalesce(F.col(c), F.lit(other)).cast(kind).alias(c) if c in requests.columns else F.lit(other).cast(kind).alias(c)

    def step(state: dict, r: tuple) -> tuple:
        if r.elapsed >= wall_seconds:
            decision = "wall_time"
        elif state["total"] >= request_cap:
            decision = "request_cap"
        elif not r.permitted:
            decision = "not_permitted"
        elif r.top_level and r.third:
            decision = "cross_site_navigation"
        elif r.third and state["others"] >= third_party_cap:
            decision = "third_party_cap"
        elif not r.public:
            decision = "not_public"
        else:
            decision, state["total"], state["others"] = "allowed", state["total"] + 1, state["others"] + bool(r.third)
        return r.run_id, r.n, r.url, decision

    rows = requests.select("run_id", "n", "url", given("top_level", "boolean", False), given("permitted", "boolean", True), given("public", "boolean", True), given("elapsed", "double", 0.0), F.coalesce(third, F.lit(True)).alias("third"))
    return folded(rows, "run_id", ["n"], "run_id string, n long, url string, decision string", lambda: {"total": 0, "others": 0}, step)


ATTEMPTED = "domain string, run_id string, request long, n long, made boolean, follow string, spent int, failures int, next_allowed_at double, circuit_until double"


def attempt_log(attempts: DataFrame, budget: int = REQUEST_BUDGET, redirects: int = REDIRECT_CAP, retries: int = RETRY_CAP, **limits: float) -> DataFrame:
    """Attempts (domain, run_id, request, n, at, status_code, retry_after) under the run's budget and the domain's pacing together.

    An attempt is made if the budget isn't spent and the domain grants a slot. A transient answer (none, 429, 503) counts for
    the domain's circuit and is tried again unless that opens it, the retries or the budget are spent or the delay (Retry-After,
    else the spacing) is too long; any other answer closes the circuit, and a redirect is followed within its cap. The
    domain's state lives on from run to run; a domain has one run at a time, so the run's is that of the current one.
    """
    pacing = Pacing(**limits)

    def begin() -> dict:
        return {"pacing": Pacing(**limits), "run": None, "request": None, "spent": 0, "redirects": 0, "retries": 0}

    def outcome(s: dict, r: tuple) -> tuple[bool, str]:
        if s["spent"] >= budget:
            return False, "budget_exhausted"
        decision, _ = s["pacing"].apply(r.at, "reserve", None)
        if decision != "granted":
            return False, decision
        s["spent"] += 1
        if r.status_code is None or r.status_code != r.status_code or int(r.status_code) in TRANSIENT:
            delay = pacing.base if r.retry_after is None or r.retry_after != r.retry_after else max(0.0, r.retry_after)
            s["pacing"].apply(r.at, "transient", delay)
            if s["pacing"].circuit > 0:
                return True, "circuit_open"
            stops = ((s["retries"] >= retries, "gave_up"), (s["spent"] >= budget, "budget_exhausted"), (delay > pacing.max_wait, "deferred"))
            follow = next((name for stop, name in stops if stop), "retry")
            s["retries"] += follow == "retry"
            return True, follow
        s["pacing"].apply(r.at, "success", None)
        if int(r.status_code) not in REDIRECTS:
            return True, "done"
        if s["redirects"] >= redirects:
            return True, "too_many_redirects"
        s["redirects"] += 1
        return True, "redirect"

    def step(s: dict, r: tuple) -> tuple:
        if r.run_id != s["run"]:
            s.update(run=r.run_id, spent=0, request=None)
        if r.request != s["request"]:
            s.update(request=r.request, redirects=0, retries=0)
        made, follow = outcome(s, r)
        p = s["pacing"]
        return r.domain, r.run_id, r.request, r.n, made, follow, s["spent"], p.failures, p.next, p.circuit

    rows = attempts.select("domain", "run_id", F.col("request").cast("long").alias("request"), F.col("n").cast("long").alias("n"), "at", F.col("status_code").cast("double").alias("status_code"), "retry_after")
    return folded(rows, "domain", ["at", "run_id", "request", "n"], ATTEMPTED, begin, step)


def attempt_outcomes(attempts: DataFrame) -> DataFrame:
    """What follows each attempt (run_id, request, n, status_code, retry_after): a redirect, a retry, a stop, or the end.

    Counts of redirects and retries before an attempt are window sums; the rules are a CASE on them.
    """
    before = Window.partitionBy("run_id", "request").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    spent = Window.partitionBy("run_id").orderBy("request", "n").rowsBetween(Window.unboundedPreceding, 0)
    status = F.col("status_code")
    transient = status.isNull() | status.isin(429, 503)
    redirect = F.coalesce(status.isin(301, 302, 303, 307, 308), F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    rows = attempts.withColumns({"redirects": count(redirect), "retries": count(transient), "spent": F.count("*").over(spent)})
    follow = (
        F.when(~redirect & ~transient, "done")
        .when(F.col("spent") >= REQUEST_BUDGET, "budget_exhausted")
        .when(redirect, F.when(F.col("redirects") >= REDIRECT_CAP, "too_many_redirects").otherwise("redirect"))
        .when(F.col("retries") >= RETRY_CAP, "gave_up")
        .when(F.coalesce("retry_after", F.lit(0.0)) > MAX_WAIT, "deferred")
        .otherwise("retry")
    )
    return rows.withColumn("follow", follow)


def leases(events: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Lease events (run_id, at, n, event acquire | renew | release, owner) with whether each took effect; compare-and-set by run."""
    schema = "run_id string, at double, n long, event string, owner string, granted boolean, expires double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, holder, until = None, None, 0.0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.run_id != current:
                    current, holder, until = r.run_id, None, 0.0
                live = holder is not None and until > r.at
                if r.event == "acquire":
                    granted = not live or holder == r.owner
                else:
                    granted = live and holder == r.owner
                if granted:
                    holder, until = (None, 0.0) if r.event == "release" else (r.owner, r.at + seconds)
                out.append((r.run_id, r.at, r.n, r.event, r.owner, granted, until))
            yield pd.DataFrame(out, columns=["run_id", "at", "n", "event", "owner", "granted", "expires"])

    return events.select("run_id", "at", "n", "event", "owner").repartition("run_id").sortWithinPartitions("run_id", "at", "n").mapInPandas(run, schema)
