"""Streaming queries run to their end (availableNow) over the tables as file streams; results are written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.sources.shared import shared_folder
from weblathe.streaming import ordered, stateful


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream; as a glob, because a stream's plain path must be a folder."""
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


def run_to_end(stream: DataFrame, mode: str, folder: str) -> None:
    """Run the stream over what there is now. A micro-batch has a folder of its own, which a repeated attempt overwrites."""
    complete = mode == "complete"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/{'complete' if complete else f'batch-{n}'}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over what there is now; the last complete result, or all that was appended."""
    folder = shared_folder(stream.sparkSession)
    run_to_end(stream, mode, folder)
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")


def drained_in_parts(rows: DataFrame, part: str, parts: int, build) -> DataFrame:
    """Deliver ``rows`` in the parts that a column numbers from 0, each after the one before was taken; all that came out."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    schema = rows.drop(part).schema
    for n in range(parts):
        rows.where(F.col(part) == n).drop(part).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        run_to_end(stream, "append", folder)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{folder}/out")


def stream_outcome_windows(spark, d):
    events = file_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("completed_at"), F.col("event_type").alias("outcome"))
    counts = drained(stateful.outcome_counts(events, "1 day"), "complete")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "outcome", "n")


def stream_first_of_each_run(spark, d):
    events = file_stream(spark, f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("completed_at"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"))
    return drained(stateful.first_of_each_run(events, "60 days"), "append").select("run_id")


def stream_changes(spark, d):
    e = file_stream(spark, f"{d}/events.parquet")
    seen = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), F.col("event_type").alias("signal"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.when(F.col("event_id") % 2 == 0, "observed").otherwise("no_evidence").alias("outcome"), F.lit("null").alias("value_json"),
    )
    return drained(stateful.change_feed(seen), "append").groupBy("domain", "signal").agg(F.count("*").alias("comparisons"), F.count_if("changed").alias("changed"))


def stream_pacing(spark, d):
    e = file_stream(spark, f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "transient").when(F.col("event_type") == "signup", "success").otherwise("reserve")
    rows = e.select(F.col("user_id").cast("string").alias("domain"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("sequence"), kind.alias("event"), F.when(kind == "transient", F.lit(60.0)).alias("amount"))
    return drained(stateful.paced(rows, cooldown=86400.0), "append")


# Events delivered in four parts, ten days each; every twentieth comes a part too late.
DAY_MS = 86_400_000
PARTS = 4


def delivered(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    part = F.least(F.lit(2), F.floor((F.dayofyear("at") - 1) / 10)) + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)
    return e.withColumn("part", part).withColumn("sequence", F.col("event_id"))


def stream_late_changes(spark, d):
    """The change feed with its late side output; a domain's signal that is idle for three days starts afresh."""
    ordered.use_rocksdb(spark)
    rows = delivered(spark, d).select(
        "part", "sequence", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), F.col("event_type").alias("signal"), F.col("at").alias("completed_at"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), F.when(F.col("event_id") % 2 == 0, "observed").otherwise("no_evidence").alias("outcome"), F.floor("value").cast("string").alias("value_json"),
    )
    return drained_in_parts(rows, "part", PARTS, lambda stream: ordered.change_feed(stream, "1 day", 3 * DAY_MS)).withColumnRenamed("tie", "sequence")


PACING = {"base": 21600.0, "threshold": 2, "cooldown": 172800.0, "max_wait": 14400.0}


def paced_events(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "transient").when(F.col("event_type") == "signup", "success").when(F.col("event_type") == "purchase", "interval").otherwise("reserve")
    amount = F.when(kind == "transient", F.floor(F.col("value") * 600).cast("double")).when(kind == "interval", F.floor(F.col("value") * 300).cast("double"))
    return events.withColumns({"event": kind, "amount": amount})


def stream_timed_pacing(spark, d):
    """Pacing with late rows told apart; a domain that is idle for four days loses its state."""
    ordered.use_rocksdb(spark)
    rows = paced_events(delivered(spark, d)).select("part", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"), "at", "sequence", "event", "amount")
    found = drained_in_parts(rows, "part", PARTS, lambda stream: ordered.paced(stream, "1 day", 4 * DAY_MS, **PACING))
    return found.select("domain", "kind", "at_ms", F.col("tie").alias("sequence"), F.when(F.col("kind") != "expired", F.col("event")).alias("event"), "decision", *(F.round(c, 3).alias(c) for c in ("wait", "next_allowed_at", "circuit_until")), "failures")


LEASE_MS = 6 * 3_600_000


def stream_leases(spark, d):
    """Leases of runs and the jobs under them: what each event did, which leases ran out, which deferrals ended."""
    ordered.use_rocksdb(spark)
    e = delivered(spark, d)
    pick = F.element_at(F.array(*(F.lit(x) for x in ("acquire", "renew", "claim", "claim", "complete", "defer", "claim", "acquire", "release", "stop"))), (F.when((F.col("event_id") % 10 == 9) & (F.col("event_id") % 190 != 9), 1).otherwise(F.col("event_id") % 10 + 1)).cast("int"))
    rows = e.select(
        "part", F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("run_id"), "at", "sequence", pick.alias("event"), F.concat(F.lit("w"), (F.col("user_id") % 2).cast("string")).alias("owner"),
        F.when(pick.isin("claim", "complete", "defer"), F.concat(F.lit("j"), (F.floor("value") % 3).cast("string"))).alias("job"), F.when(pick == "defer", F.unix_millis("at") + F.floor("value").cast("long") * 3_600_000).alias("until_ms"),
    )
    found = drained_in_parts(rows, "part", PARTS, lambda stream: ordered.leases(stream, "1 day", LEASE_MS))
    return found.select("run_id", "kind", "at_ms", F.col("tie").alias("sequence"), "event", "owner", "granted", F.array_join("jobs", ",").alias("jobs"))


QUERIES = {f.__name__: f for f in (stream_outcome_windows, stream_first_of_each_run, stream_changes, stream_pacing, stream_late_changes, stream_timed_pacing, stream_leases)}

# Events with their part, whether they came behind the watermark, and in order of time for each key.
DELIVERED = f"""e as (select *, epoch_us(ts) // 1000 as at_ms, least(2, (dayofyear(ts) - 1) // 10) + case when event_id % 20 = 0 then 1 else 0 end as part from events),
marks as (select p as part, (select max(at_ms) from e where part < p) - {DAY_MS} as mark from range({PARTS + 1}) t(p)),
w as (select e.*, coalesce(at_ms <= mark, false) as late, (select mark from marks where part = {PARTS}) as last_mark from e join marks using (part))"""


def idle_sql(keys: str, idle: int) -> str:
    """Rows that were taken, in order, with whether the key's state was new (idle before), and whether and when it went idle after."""
    return f"""o as (select *, row_number() over k as rn, coalesce(at_ms >= lag(at_ms) over k + {idle}, true) as fresh, least(coalesce(lead(at_ms) over k, 9223372036854775807), last_mark) >= at_ms + {idle} as ends
 from w where not late and at_ms <= last_mark window k as (partition by {keys} order by at_ms, event_id))"""


def late_changes_sql() -> str:
    return f"""with {DELIVERED}, v as (select *, 'u' || user_id as domain, event_type as signal, lpad(cast(event_id as varchar), 12, '0') as run_id, case when event_id % 2 = 0 then 'observed' else 'no_evidence' end as outcome, floor(value) as val from w),
{idle_sql("domain, signal", 3 * DAY_MS).replace("from w", "from v")},
c as (select *, lag(run_id) over k as b, lag(outcome) over k as bo, lag(val) over k as bv from o window k as (partition by domain, signal order by rn))
select domain, signal, 'taken' as kind, at_ms, event_id as sequence, b as previous_run_id, run_id, bo as previous_outcome, outcome, (outcome, val) <> (bo, bv) as changed from c where not fresh
union all select domain, signal, 'expired', at_ms + {3 * DAY_MS}, -1, run_id, null, outcome, null, null from c where ends
union all select domain, signal, 'late', at_ms, event_id, null, run_id, null, outcome, null from v where late"""


def paced_sql(keys: str, limits: dict, source: str) -> str:
    """A recursive fold over ``source`` (the keys, rn, now, event, amount, fresh), one step for the n-th rows of all keys: ``f``."""
    base, threshold, cooldown, longest = (limits[k] for k in ("base", "threshold", "cooldown", "max_wait"))
    same = " and ".join(f"s.{k} = f.{k}" for k in keys.split(", "))
    return f"""f as (select {keys}, 0::bigint as rn, 0::double as now, null::varchar as event, null::varchar as decision, 0::double as wait, 0::double as nxt, 0::double as gap, 0 as failures, 0::double as circuit, 0::double as updated from (select distinct {keys} from {source})
 union all select {keys}, rn, now, event, case when event = 'reserve' then case when circuit > now then 'rejected' when free > {longest} then 'deferred' else 'granted' end when event = 'transient' and tries >= {threshold} then 'opened' else event end,
  case when event <> 'reserve' then 0 when circuit > now then circuit - now else free end,
  case when event = 'reserve' then case when circuit > now or free > {longest} then nxt else greatest(now, nxt) + greatest({base}, gap) end when event = 'interval' then now + coalesce(amount, 0) when event = 'transient' then blocked else nxt end,
  case when event = 'interval' then coalesce(amount, 0) else gap end,
  case when event = 'transient' then tries when event = 'success' then 0 else failures end,
  case when event = 'success' then 0 when event = 'transient' and tries >= {threshold} then greatest(circuit, blocked, now + {cooldown}) else circuit end,
  case when event = 'reserve' then updated else now end
 from (select {", ".join(f"s.{k}" for k in keys.split(", "))}, s.rn, s.now, s.event, s.amount, x.nxt, x.gap, x.failures, x.circuit, x.updated, greatest(0, x.nxt - s.now) as free,
   case when s.now - x.updated <= {cooldown} then x.failures + 1 else 1 end as tries, greatest(x.nxt, s.now + coalesce(s.amount, 0)) as blocked
  from f join {source} s on {same} and s.rn = f.rn + 1,
  lateral (select case when s.fresh then 0 else f.nxt end as nxt, case when s.fresh then 0 else f.gap end as gap, case when s.fresh then 0 else f.failures end as failures, case when s.fresh then 0 else f.circuit end as circuit, case when s.fresh then 0 else f.updated end as updated) x))"""


PACED_EVENTS = "case event_type when 'error' then 'transient' when 'signup' then 'success' when 'purchase' then 'interval' else 'reserve' end as event, case event_type when 'error' then floor(value * 600) when 'purchase' then floor(value * 300) end as amount"


def timed_pacing_sql() -> str:
    return f"""with recursive {DELIVERED}, v as (select *, 'u' || user_id as domain, {PACED_EVENTS} from w),
{idle_sql("domain", 4 * DAY_MS).replace("from w", "from v")}, q as (select *, at_ms / 1000.0::double as now from o),
{paced_sql("domain", PACING, "q")}
select domain, 'taken' as kind, at_ms, event_id as sequence, q.event, decision, round(wait, 3) as wait, round(nxt, 3) as next_allowed_at, round(circuit, 3) as circuit_until, failures from f join q using (domain, rn)
union all select domain, 'expired', at_ms + {4 * DAY_MS}, -1, null, null, null, null, null, null from o where ends
union all select domain, 'late', at_ms, event_id, event, null, null, null, null, null from v where late"""


def leases_sql() -> str:
    """Three jobs a run as lists of states (p, r, c, d) and of the times when deferrals end; time alone acts before each row and at the end."""
    return f"""with recursive {DELIVERED},
v as (select *, 'r' || (user_id % 40) as run_id, ['acquire', 'renew', 'claim', 'claim', 'complete', 'defer', 'claim', 'acquire', 'release', 'stop'][case when event_id % 10 = 9 and event_id % 190 <> 9 then 1 else event_id % 10 + 1 end] as event, 'w' || (user_id % 2) as owner, cast(floor(value) as bigint) as val from w),
s0 as (select run_id, at_ms, event_id as sequence, event, owner, case when event in ('claim', 'complete', 'defer') then val % 3 + 1 end as job, at_ms + val * 3600000 as until from v where not late and at_ms <= last_mark
 union all select distinct run_id, (select max(last_mark) from w), 9223372036854775807, 'end', null, null::bigint, null::bigint from v where not late and at_ms <= last_mark),
s as (select *, row_number() over (partition by run_id order by at_ms, sequence) as rn from s0),
f as (select distinct run_id, 0::bigint as rn, null::varchar as holder, 0::bigint as upto, false as stopped, ['p', 'p', 'p'] as jobs, [0, 0, 0]::bigint[] as times, 0::bigint as at_ms, 0::bigint as sequence, null::varchar as event, null::varchar as owner, null::bigint as job, false as granted,
  false as ran_out, null::varchar as last_holder, 0::bigint as ran_out_at, ['p', 'p', 'p'] as jobs_before, [0, 0, 0]::bigint[] as times_before from s
 union all select run_id, rn, case when granted and event in ('acquire', 'renew') then owner when granted and event = 'release' then null else live end,
  case when granted and event in ('acquire', 'renew') then at_ms + {LEASE_MS} else upto end, stopped or event = 'stop',
  list_transform(jobs, lambda j, i: case when granted and i = job then case event when 'claim' then 'r' when 'complete' then 'c' when 'defer' then case when until <= at_ms then 'p' else 'd' end else j end else j end),
  list_transform(times, lambda t, i: case when granted and i = job and event = 'defer' then until else t end),
  at_ms, sequence, event, owner, job, granted, ran_out, last_holder, upto, jobs_before, times_before
 from (select *, coalesce(case event when 'acquire' then live is null or live = owner when 'stop' then true when 'claim' then live = owner and not stopped and jobs[job] = 'p' when 'complete' then live = owner and jobs[job] = 'r' when 'defer' then live = owner and jobs[job] = 'r' else live = owner end, false) as granted
  from (select s.*, f.stopped, f.upto, f.holder as last_holder, f.jobs as jobs_before, f.times as times_before, f.times, f.holder is not null and f.upto <= s.at_ms as ran_out, case when f.holder is not null and f.upto > s.at_ms then f.holder end as live,
    list_transform(f.jobs, lambda j, i: case when j = 'r' and f.holder is not null and f.upto <= s.at_ms then 'p' when j = 'd' and f.times[i] <= s.at_ms then 'p' else j end) as jobs
   from f join s on s.run_id = f.run_id and s.rn = f.rn + 1))),
g as (select * from f where rn > 0)
select run_id, 'taken' as kind, at_ms, sequence, event, owner, granted, coalesce('j' || (job - 1), '') as jobs from g where event <> 'end'
union all select run_id, 'woken', ran_out_at, -1, 'lease_expired', last_holder, true, array_to_string(list_filter(list_transform(jobs_before, lambda j, i: case when j = 'r' then 'j' || (i - 1) end), lambda x: x is not null), ',') from g where ran_out
union all select run_id, 'woken', t, -1, 'deferral_over', null, true, string_agg('j' || (i - 1), ',' order by i) from (select run_id, rn, times_before[i] as t, i from g, range(1, 4) x(i) where jobs_before[i] = 'd' and times_before[i] <= at_ms) group by run_id, rn, t
union all select run_id, 'late', at_ms, event_id, event, owner, null, null from v where late"""


SQL = {
    "stream_outcome_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as outcome, count(*) as n from events group by all",
    "stream_first_of_each_run": "select distinct 'u' || user_id as run_id from events",
    "stream_late_changes": late_changes_sql(),
    "stream_timed_pacing": timed_pacing_sql(),
    "stream_leases": leases_sql(),
    "stream_changes": "with l as (select 'u' || user_id as domain, event_type as signal, event_id % 2 as o, lag(event_id % 2) over (partition by user_id, event_type order by ts, event_id) as b from events) select domain, signal, count(*) as comparisons, count(*) filter (o <> b) as changed from l where b is not null group by all",
}
