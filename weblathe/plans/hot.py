"""Windows of the analytics over tables in which one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weblathe.operators import ranges
from weblathe.plans.corpus import table


def hot_running_caps(spark, d):
    """Running requests and bytes of a user, one of whom makes a third of all requests, and what is within the caps."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("user_id"), "ts", F.round(F.col("value") * 100).cast("long").alias("bytes"))
    found = ranges.running(e, ["user_id"], ["ts", "event_id"], {"total_bytes": F.col("bytes")}, "nth")
    return found.select("event_id", "user_id", "nth", "total_bytes", ((F.col("nth") <= 30) & (F.col("total_bytes") <= 60_000)).alias("within_cap"))


def hot_job_ordinals(spark, d):
    """Line items as the targets of runs: the first of each origin, numbered in its run; one run has a third of them."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_partkey").alias("origin"))
    first = rows.groupBy("run_id", "origin").agg(F.min("position").alias("position"))
    return ranges.running(first, ["run_id"], ["position", "origin"], rank="n").select("run_id", "origin", "position", (F.col("n") - 1).alias("ordinal"))


def hot_stratum_ranks(spark, d):
    """Orders as a frame: seeded ranks in strata and the chosen ones, with the spend up to them; one stratum has a third."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "hot").otherwise(F.col("o_orderpriority")).alias("stratum"), F.md5(F.concat(F.lit("pilot-1:"), F.col("o_orderkey").cast("string"))).alias("draw"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    found = ranges.running(o, ["stratum"], ["draw", "o_orderkey"], {"spent": F.col("cents")})
    return found.select("o_orderkey", "stratum", "rank", "spent", (F.col("rank") <= 40).alias("selected"))


QUERIES = {f.__name__: f for f in (hot_running_caps, hot_job_ordinals, hot_stratum_ranks)}
SQL = {
    "hot_running_caps": """with e as (select event_id, case when user_id % 3 = 0 then 0 else user_id end as user_id, ts, cast(round(value * 100) as bigint) as b from events),
w as (select event_id, user_id, row_number() over k as nth, cast(sum(b) over (k rows unbounded preceding) as bigint) as total_bytes from e window k as (partition by user_id order by ts, event_id))
select *, nth <= 30 and total_bytes <= 60000 as within_cap from w""",
    "hot_job_ordinals": """with f as (select case when l_suppkey % 3 = 0 then 0 else l_suppkey end as run_id, l_partkey as origin, min(l_orderkey * 10 + l_linenumber) as position from lineitem group by all)
select run_id, origin, position, row_number() over (partition by run_id order by position, origin) - 1 as ordinal from f""",
    "hot_stratum_ranks": """with o as (select o_orderkey, case when o_custkey % 3 = 0 then 'hot' else o_orderpriority end as stratum, md5('pilot-1:' || o_orderkey) as draw, cast(round(o_totalprice * 100) as bigint) as cents from orders),
w as (select o_orderkey, stratum, row_number() over k as rank, cast(sum(cents) over (k rows unbounded preceding) as bigint) as spent from o window k as (partition by stratum order by draw, o_orderkey))
select *, rank <= 40 as selected from w""",
}
