"""The engine's queries over the star-schema tables, shaped into snapshots, frames, jobs and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblathe.functions import values
from weblathe.functions.text import any_of, has_marker, suffix_match, words_of
from weblathe.functions.urls import registrable_domain
from weblathe.operators import analysis, jobs, sampling

SEED = "pilot-1"
PER_STRATUM = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def event_observations(events: DataFrame) -> DataFrame:
    """Events as the long table of observations: a run is a user's day, a signal an event type (the last one counts)."""
    rows = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("domain"),
        F.date_format("ts", "yyyyMMdd").alias("day"),
        F.concat(F.lit("act."), F.col("event_type")).alias("signal"),
        "event_id", "ts",
        F.element_at(F.array(*(F.lit(o) for o in ("observed", "observed", "no_evidence", "skipped", "error"))), (F.col("event_id") % 5 + 1).cast("int")).alias("outcome"),
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )
    last = F.row_number().over(Window.partitionBy("domain", "day", "signal").orderBy(F.desc("ts"), F.desc("event_id")))
    done = F.max("ts").over(Window.partitionBy("domain", "day"))
    kept = rows.withColumns({"_last": last, "done": done}).where("_last = 1")
    value = F.when(F.col("outcome") == "observed", F.concat(F.lit('{"k":'), F.expr("cast(k div 50 as string)"), F.lit("}"))).otherwise(F.lit("null"))
    sure = F.when(F.col("outcome") == "observed", "confirmed").when(F.col("outcome") == "no_evidence", "no_evidence").otherwise("unknown")
    return kept.select(
        F.concat_ws("-", "domain", "day").alias("run_id"), "domain", stamp(F.col("done")).alias("completed_at"), "signal", "outcome", sure.alias("confidence"),
        F.when(F.col("outcome").isin("observed", "no_evidence"), 1.0).otherwise(0.0).alias("confidence_score"), value.alias("value_json"), F.lit("last event of the day").alias("method"), F.lit(1).alias("evidence_count"),
    )


def catalog(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(f"act.{s}") for s in ("view", "click", "signup", "purchase", "refund")))).alias("signal"))


def customer_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sampling frame."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    band = F.when(F.col("c_acctbal") >= 6000, "head").when(F.col("c_acctbal") >= 2500, "mid").otherwise("tail")
    eligible = F.col("c_acctbal") >= 0
    return joined.select(
        F.col("c_name").alias("domain"), F.array(F.concat(F.lit("list"), (F.col("c_custkey") % 3).cast("string"))).alias("sources"), F.col("c_mktsegment").alias("sector"), F.col("r_name").alias("geography"),
        band.alias("popularity_band"), eligible.alias("eligible"), F.when(~eligible, "negative balance").alias("exclusion_reason"), F.col("c_acctbal").alias("balance"),
    )


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.select_sample(customer_frame(spark, sf_dir), SEED, PER_STRATUM)


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: ten runs by customer, deferred until the day after the order."""
    o = table(spark, sf_dir, "orders")
    late = F.col("o_orderkey") % 7
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", F.when(late == 0, "running").when(late == 1, "deferred").otherwise("pending"))
    status = status.otherwise(F.when(late == 0, "failed").when(late == 1, "completed_with_notes").when(late == 2, "ceased").otherwise("completed"))
    return o.select(
        (F.col("o_custkey") % 10).alias("run_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("registrable_domain"), status.alias("status"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("not_before"), late.alias("request_count"), F.lit(0).alias("attempts"),
    )


def order_runs(spark: SparkSession) -> DataFrame:
    """Runs 0 to 9: even ones belong to a, those below 8 hold a live lease, run 4 is asked to stop."""
    run = F.col("id").alias("run_id")
    return spark.range(10).select(run, F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("owner"), F.when(F.col("id") < 8, 100.0).otherwise(0.0).alias("lease_expires"), (F.col("id") == 4).alias("stop_requested"))


def line_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as HTTP attempts of an order's scan; one kind has no response."""
    status = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") == 1, 403).otherwise(429)).when(F.col("l_linestatus") == "O", 200).when(F.col("l_linenumber") > 2, 404)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), status.alias("status_code"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"))


# Queries, by name


def analysis_observations(spark, d):
    return event_observations(table(spark, d, "events"))


def analysis_runs(spark, d):
    return analysis.run_counts(analysis_observations(spark, d))


def analysis_changes(spark, d):
    return analysis.longitudinal_changes(analysis_observations(spark, d))


def analysis_summary(spark, d):
    return analysis.summary(analysis_observations(spark, d))


def analysis_totals(spark, d):
    seen = analysis_observations(spark, d)
    return analysis.totals(seen, analysis.longitudinal_changes(seen))


def transition_matrix(spark, d):
    return analysis.transitions(analysis_changes(spark, d))


def coverage_heatmap(spark, d):
    return analysis.outcome_shares(analysis_observations(spark, d), "signal")


def catalog_left_join(spark, d):
    return analysis.complete_catalog(analysis_observations(spark, d), catalog(spark)).select("run_id", "domain", "signal", "outcome", "value_json")


def missing_signals_anti(spark, d):
    return analysis.outside_catalog(analysis_observations(spark, d), catalog(spark)).select("run_id", "signal", "outcome")


def report_status_counts(spark, d):
    return analysis.status_counts(analysis_observations(spark, d), "domain")


def report_common_statuses(spark, d):
    return analysis.common_statuses(analysis_observations(spark, d))


def dimension_scores(spark, d):
    weight = F.length("signal").cast("double")
    value = F.when(F.col("outcome") == "observed", F.regexp_extract("value_json", r"(\d+)", 1).cast("double"))
    seen = analysis_observations(spark, d).withColumns({"w": weight, "x": F.when(F.col("outcome") == "observed", value)})
    return analysis.dimension_score(seen, F.col("w"), F.col("x"), 0.5)


def signal_cooccurrence(spark, d):
    return analysis.cooccurrence(analysis_observations(spark, d))


def frame_sample(spark, d):
    return sample(spark, d).select("domain", *sampling.STRATUM, "eligible", "exclusion_reason", "random_order", "stratum_size", "selected", "inclusion_probability")


def frame_strata(spark, d):
    return sampling.strata(customer_frame(spark, d), PER_STRATUM)


def frame_manifest(spark, d):
    return sampling.manifest(sample(spark, d), SEED, PER_STRATUM)


def frame_panel(spark, d):
    return sampling.panel_split(sample(spark, d)).select("domain", *sampling.STRATUM, "random_order", "part")


def frame_merge(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 60).cast("string")).alias("domain"), F.concat(F.lit("list"), (F.col("s_suppkey") % 4).cast("string")).alias("source"), F.when(F.col("s_acctbal") > 0, "commerce").otherwise("media").alias("sector"), (F.col("s_suppkey") % 60 % 5).cast("string").alias("geography"), F.lit("mid").alias("popularity_band"), F.lit(True).alias("eligible"), F.lit(None).cast("string").alias("exclusion_reason"))
    return sampling.merge_frame(rows).select("domain", F.array_join("sources", ",").alias("sources"), "conflict")


def design_weighted_mean(spark, d):
    means = sampling.design_means(sample(spark, d), "balance")
    return means.select("n", "population", F.round("weighted_mean", 6).alias("weighted_mean"), F.round("standard_error", 6).alias("standard_error"))


def quality_gates(spark, d):
    return sampling.quality_gates(sample(spark, d).where("selected").withColumn("complete", F.col("balance") % 10 >= 1))


def job_progress(spark, d):
    return jobs.progress(order_jobs(spark, d))


def run_statuses(spark, d):
    return jobs.run_status(job_progress(spark, d), F.col("run_id") == 4).select("run_id", "run_status")


def claimable_jobs(spark, d):
    return jobs.next_claims(order_jobs(spark, d), order_runs(spark), "a", F.lit(50.0)).select("run_id", "ordinal", "registrable_domain", "status", "attempts")


def resume_jobs(spark, d):
    return jobs.resume(order_jobs(spark, d), F.to_date(F.lit("1996-01-01"))).select("run_id", "ordinal", "status")


def http_status_distribution(spark, d):
    return line_attempts(spark, d).where("status_code is not null").groupBy("run_id", "status_code").agg(F.count("*").alias("n"))


def http_403_rate(spark, d):
    grouped = line_attempts(spark, d).groupBy("run_id").agg(F.count_if(F.col("status_code") == 403).alias("forbidden"), F.count_if(F.col("status_code") == 429).alias("limited"), F.count("status_code").alias("responses"))
    rate = lambda c: F.when(F.col("responses") > 0, F.col(c) / F.col("responses"))
    return grouped.select("run_id", "forbidden", "limited", "responses", rate("forbidden").alias("rate_403"), rate("limited").alias("rate_429"), F.when(F.col("responses") == 0, "no_evidence").otherwise("observed").alias("outcome"))


def registrable_hosts(spark, d):
    return page_hosts(spark, d).select("page_id", "host", registrable_domain(F.col("host")).alias("registrable"))


def cease_filter(spark, d):
    hosts = page_hosts(spark, d)
    names = hosts.select("host").distinct()
    listed = names.where(F.length("host") % 5 == 0).select(F.col("host").alias("domain")).unionByName(spark.range(1).select(F.lit("example.net").alias("domain")))
    blocked = jobs.cease_matches(names, listed)
    return hosts.join(blocked, "host", "left").select("page_id", "host", "ceased_by")


def provider_suffix_join(spark, d):
    """The same match as a theta join against a constant table of suffixes, which is broadcast."""
    table_ = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("provider"), F.lit(s).alias("suffix")) for p, s in (("org", "example.org"), ("net", "example.net"), ("mobile", "m."), ("www", "www-"))))))
    hosts = page_hosts(spark, d)
    return hosts.join(F.broadcast(table_), suffix_match(F.col("host"), F.col("suffix"))).select("page_id", "provider")


def page_metadata(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.length(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)).alias("title_chars"), F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(html, F.lit('<a href="')).alias("links").cast("long"))


def page_link_words(spark, d):
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")
    links = table(spark, d, "pages").select("page_id", hrefs)
    marked = any_of(has_marker(F.col("href"), m) for m in ("the", "of", "in-of"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(marked).alias("marked"), F.count_distinct("href").alias("distinct_links"))


def policy_text_rules(spark, d):
    docs = table(spark, d, "documents")
    rules = {"licensed": r"(?i)\b(?:is )?licensed under\b", "released": r"(?i)\breleased under the [a-z]+ license\b", "reserved": r"(?i)\ball rights reserved\b"}
    found = docs.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules.items())))).alias("rule"))
    return found


def license_lines(spark, d):
    """Every line that says licensed, with the number of documents that hold it."""
    said = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"(?i)licen[sc]ed? "))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(said)).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def detector_scores(spark, d):
    words = F.size(F.split("text", " "))
    flag = F.when(words < 20, None).otherwise(F.col("text").rlike(r"[#*$%&]{3}"))
    judged = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", flag.alias("flag"), (F.col("quality") == 0).alias("truth"))
    return analysis.detector_validation(judged, "lang")


def dedup_first_seen(spark, d):
    order = F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))
    digests = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return digests.withColumn("_n", order).where("_n = 1").select("doc_id", "digest")


def content_change(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    before = F.lag("digest").over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select("doc_id", "source", before.alias("_b"), "digest").select("doc_id", "source", F.when(F.col("_b").isNull(), "not_comparable").when(F.col("_b") == F.col("digest"), "unchanged").otherwise("changed").alias("result"))


def set_operations(spark, d):
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    rich = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    every = [tag(buyers.intersect(rich), "intersect"), tag(rich.exceptAll(buyers.distinct()), "except"), tag(buyers.union(rich).distinct(), "union")]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("op").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


def outcome_windows(spark, d):
    seen = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    grouped = seen.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(stamp(F.col("w.start")).alias("window_start"), "event_type", "n")


def outcome_sliding_windows(spark, d):
    seen = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    grouped = seen.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(stamp(F.col("w.start")).alias("window_start"), "n")


def user_sessions(spark, d):
    seen = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    grouped = seen.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", stamp(F.col("w.start")).alias("session_start"), "n")


def running_caps(spark, d):
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, d, "events").withColumn("nth", F.count("*").over(upto))
    return rows.select("event_id", "user_id", "nth", (F.col("nth") <= 30).alias("within_cap"))


def asof_prices(spark, d):
    """Each purchase with the user's last view before it: an as-of join as one window over the union of both sides."""
    e = table(spark, d, "events").where("event_type in ('view', 'purchase')")
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True)
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last_view", last.over(before)).where("event_type = 'purchase'").select("event_id", "user_id", "last_view")


def pacing_fold(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "transient").when(F.col("event_type") == "signup", "success").otherwise("reserve")
    rows = e.select(F.col("user_id").cast("string").alias("domain"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("sequence"), kind.alias("event"), F.when(kind == "transient", F.lit(60.0)).alias("amount"))
    return jobs.pace(rows, cooldown=86400.0)


def observation_values(spark, d):
    """Events' properties as JSON values of every kind: what each is, its whole numbers, and its canonical text."""
    e = table(spark, d, "events")
    k, n = F.regexp_extract("props", r"(\d+)", 1), F.col("event_id") % 9
    given = (
        F.when(n == 0, F.col("props"))
        .when(n == 1, F.concat(F.lit("-7"), k, F.lit("00000000000000000000"), k))  # beyond 64 bits
        .when(n == 2, F.concat(k, F.lit(".50")))
        .when(n == 3, F.concat(F.lit(' {"z": ['), k, F.lit(', true], "k": '), F.col("event_id").cast("string"), F.lit("0000000000}")))
        .when(n == 4, F.when(k.cast("int") % 2 == 0, "true").otherwise(F.lit("null")))
        .when(n == 5, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
        .when(n == 6, F.concat(F.lit("{broken"), k))
        .when(n == 7, F.concat(F.lit('{"k": '), k, F.lit(".5}")))
        .otherwise(F.concat(F.lit("[1, "), k, F.lit("]")))
    )
    rows = e.select("event_id", given.alias("given"))
    number = lambda path: values.whole_number(F.col("given"), path).cast("string")
    return rows.select("event_id", values.kind(F.col("given")).alias("kind"), values.kind(F.col("given"), "$.k").alias("kind_of_k"), number("$").alias("whole"), number("$.k").alias("k"), values.canonical(F.col("given")).alias("canonical"))


def title_words(spark, d):
    w = F.explode(words_of(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))).alias("word")
    return table(spark, d, "pages").select(w).groupBy("word").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        analysis_changes, analysis_observations, analysis_runs, analysis_summary, analysis_totals, transition_matrix, coverage_heatmap, catalog_left_join, missing_signals_anti,
        report_status_counts, report_common_statuses, dimension_scores, signal_cooccurrence, frame_sample, frame_strata, frame_manifest, frame_panel, frame_merge,
        observation_values, design_weighted_mean, quality_gates, job_progress, run_statuses, claimable_jobs, resume_jobs, http_status_distribution, http_403_rate, registrable_hosts, cease_filter,
        provider_suffix_join, page_metadata, page_link_words, title_words, policy_text_rules, license_lines, detector_scores, dedup_first_seen, content_change, set_operations, outcome_windows,
        outcome_sliding_windows, user_sessions, running_caps, asof_prices, pacing_fold,
    )
}
