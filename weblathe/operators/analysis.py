"""Runs, observations, changes and summaries of snapshots.

The long table of observations has one row for each (run_id, signal): run_id, domain, completed_at,
signal, outcome, confidence, confidence_score, value_json, method, evidence_count. The four
outcomes observed, no_evidence, skipped and error are never folded into one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.functions.text import family
from weblathe.functions.values import whole_number
from weblathe.functions.vocabulary import OUTCOMES


def outcome_counts(outcome: str = "outcome") -> list[Column]:
    """One count for each outcome, zero if it doesn't occur."""
    names = {"observed": "observed", "no_evidence": "no_evidence", "skipped": "skipped", "error": "errors"}
    return [F.count_if(F.col(outcome) == o).alias(names[o]) for o in OUTCOMES]


def runs_of_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row for each snapshot (observations as a map): narrow, no shuffle.

    browser_requests is the whole number that the browser's summary holds, 0 if it holds none, null beyond 64 bits.
    """
    values = F.map_values("observations")
    count = lambda o: F.size(F.filter(values, lambda x: x["outcome"] == o)).cast("long")
    requests = whole_number(F.try_element_at("observations", F.lit("browser.network_summary"))["value_json"], "$.requests")
    return snapshots.select(
        "run_id", "domain", "origin", "started_at", "completed_at", "collector_version",
        F.col("request_count").alias("http_requests"),
        F.when(requests.isNull(), F.lit(0).cast("long")).otherwise(requests.try_cast("long")).alias("browser_requests"),
        count("observed").alias("observed"), count("no_evidence").alias("no_evidence"), count("skipped").alias("skipped"), count("error").alias("errors"),
        F.size("errors").cast("long").alias("probe_errors"),
    )


def observations_of_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row for each (snapshot, signal)."""
    rows = snapshots.select("run_id", "domain", "completed_at", F.explode("observations").alias("signal", "o"))
    return rows.select("run_id", "domain", "completed_at", "signal", "o.outcome", "o.confidence", "o.confidence_score", "o.value_json", "o.method", F.size("o.evidence").alias("evidence_count"))


def run_counts(observations: DataFrame) -> DataFrame:
    """Outcome counts of each run, from the long table."""
    return observations.groupBy("run_id", "domain", "completed_at").agg(F.count("*").alias("observations"), *outcome_counts())


def last_runs(observations: DataFrame, n: int = 2) -> DataFrame:
    """The observations of each domain's last ``n`` runs by (completed_at, run_id), with their rank, last first.

    Runs are ranked before observations join them, so the window sorts runs, not observations.
    """
    runs = observations.select("domain", "run_id", "completed_at").distinct()
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("completed_at"), F.desc("run_id")))
    kept = runs.withColumn("run_rank", rank).where(F.col("run_rank") <= n).select("domain", "run_id", "run_rank")
    return observations.join(kept, ["domain", "run_id"])


def longitudinal_changes(observations: DataFrame) -> DataFrame:
    """The last two runs of each domain, compared on the signals that both have.

    A signal changed if its outcome or its canonical value differs; confidence and method don't count.
    Domains with one run are left out. One shuffle: both runs of a signal meet in one group.
    """
    side = lambda r, c: F.max(F.when(F.col("run_rank") == r, F.col(c)))
    paired = last_runs(observations).groupBy("domain", "signal").agg(
        F.count("*").alias("_n"),
        *(side(r, c).alias(f"{name}_{c}") for r, name in ((2, "previous"), (1, "current")) for c in ("run_id", "completed_at", "outcome", "value_json")),
    )
    same = F.col("previous_outcome").eqNullSafe(F.col("current_outcome")) & F.col("previous_value_json").eqNullSafe(F.col("current_value_json"))
    return paired.where("_n = 2").drop("_n").withColumn("changed", ~same)


def summary(observations: DataFrame) -> DataFrame:
    """Outcome counts over all and by signal, in one pass of grouping sets (scope, signal, outcome, n)."""
    grouped = observations.groupingSets([["outcome"], ["signal", "outcome"]], "signal", "outcome").agg(F.count("*").alias("n"), F.grouping("signal").alias("_all"))
    return grouped.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("signal")).alias("scope"), "signal", "outcome", "n")


def totals(observations: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: snapshots, domains, signals, comparisons, changed, unchanged."""
    counts = observations.agg(F.count_distinct("run_id").alias("snapshots"), F.count_distinct("domain").alias("domains"), F.count_distinct("signal").alias("signals"))
    compared = changes.agg(F.count("*").alias("comparisons"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"))
    parts = counts.unionByName(compared, allowMissingColumns=True)  # one row each
    return parts.agg(*(F.max(c).alias(c) for c in parts.columns))


def transitions(changes: DataFrame) -> DataFrame:
    """How often outcomes followed one another, by signal family."""
    return changes.groupBy(family(F.col("signal")).alias("family"), "previous_outcome", "current_outcome").agg(F.count("*").alias("n"))


def outcome_shares(observations: DataFrame, *by: str) -> DataFrame:
    """Each outcome's share among the observations of a group."""
    counted = observations.groupBy(*by, "outcome").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def signals_of(catalog: DataFrame, most: int = 10_000) -> Column:
    """The catalog's signals as a constant array; a catalog is a short list, a longer table is refused."""
    names = [r["signal"] for r in catalog.select("signal").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"a catalog of more than {most} signals")
    return F.array(*(F.lit(n) for n in names)).cast("array<string>")


def complete_catalog(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every run with every signal of the catalog; what a run lacks is skipped."""
    runs = observations.select("run_id", "domain").distinct()
    wanted = runs.withColumn("signal", F.explode(signals_of(catalog)))
    found = observations.select("run_id", "signal", "outcome", "value_json")
    joined = wanted.join(found, ["run_id", "signal"], "left")
    return joined.withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))


def outside_catalog(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Observations whose signal the catalog doesn't know."""
    return observations.join(catalog.select("signal"), "signal", "left_anti")


def status_counts(observations: DataFrame, *by: str) -> DataFrame:
    """Report status counts (collected, no_evidence, skipped, error), zero-filled."""
    return observations.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias("collected" if o == "observed" else o) for o in OUTCOMES))


def common_statuses(observations: DataFrame) -> DataFrame:
    """Signals by status, most common first, as "signal (n/total)"."""
    counted = observations.groupBy("signal", "outcome").agg(F.count("*").alias("n"))
    counted = counted.withColumn("total", F.sum("n").over(Window.partitionBy("signal")))  # at most four rows a signal
    rank = F.row_number().over(Window.partitionBy("outcome").orderBy(F.desc("n"), "signal"))
    label = F.concat("signal", F.lit(" ("), F.col("n").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))
    return counted.select("outcome", rank.alias("rank"), label.alias("label"))


def dimension_score(observations: DataFrame, weight: Column, value: Column, least_coverage: float) -> DataFrame:
    """Weighted mean of scored observations of each run and family, over observed signals only, with
    coverage; no score below the least coverage."""
    rows = observations.select("run_id", family(F.col("signal")).alias("family"), "outcome", weight.alias("w"), value.alias("x"))
    observed = F.col("outcome") == "observed"
    grouped = rows.groupBy("run_id", "family").agg(
        F.sum(F.when(observed, F.col("w") * F.col("x"))).alias("_wx"), F.sum(F.when(observed, F.col("w"))).alias("_w"), (F.count_if(observed) / F.count("*")).alias("coverage")
    )
    return grouped.select("run_id", "family", "coverage", F.when(F.col("coverage") >= least_coverage, F.try_divide("_wx", "_w")).alias("score"))


def cooccurrence(observations: DataFrame) -> DataFrame:
    """How many domains have both of two signals observed. A domain's signals are few (at most the catalog), so its pairs are, too."""
    sets = observations.where("outcome = 'observed'").groupBy("domain").agg(F.array_sort(F.collect_set("signal")).alias("s"))
    pairs = sets.select(F.explode("s").alias("signal_a"), "s").select("signal_a", F.explode("s").alias("signal_b")).where("signal_a < signal_b")
    return pairs.groupBy("signal_a", "signal_b").agg(F.count("*").alias("domains"))


def detector_validation(judged: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and abstention of a detector: rows with ``flag`` (null: abstained) and ``truth``."""
    hit, flag, truth = F.col("flag") & F.col("truth"), F.col("flag"), F.col("truth")
    grouped = judged.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(flag & ~truth).alias("fp"), F.count_if(~F.coalesce(flag, F.lit(False)) & truth).alias("fn"), F.count_if(flag.isNull()).alias("abstained"), F.count("*").alias("n"))
    return grouped.select(*by, "tp", "fp", "fn", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), (F.col("abstained") / F.col("n")).alias("abstention"))


def failed_results(failures: DataFrame, catalog: DataFrame) -> DataFrame:
    """A failed target (target, message) as one error for each signal of the catalog, a constant table."""
    return failures.select("target", F.lit(None).cast("string").alias("domain"), F.explode(signals_of(catalog)).alias("signal"), F.lit("error").alias("outcome"), F.col("message").alias("method"))


def run_totals(runs: DataFrame) -> DataFrame:
    """Requests, failures and notes over the rows of ``runs_of_snapshots``; a null domain is a failed target."""
    return runs.agg(F.count("*").alias("targets"), F.coalesce(F.sum("http_requests"), F.lit(0)).alias("requests"), F.count_if(F.col("domain").isNull()).alias("failed"), F.coalesce(F.sum("probe_errors"), F.lit(0)).alias("notes"))


def stratum_shares(observations: DataFrame, selection: DataFrame) -> DataFrame:
    """Outcome shares by family and stratum: observations joined with the selected domains they belong to."""
    strata = selection.where("selected").select("domain", F.concat_ws("/", "sector", "geography", "popularity_band").alias("stratum"))
    return outcome_shares(observations.withColumn("family", family(F.col("signal"))).join(strata, "domain"), "stratum", "family")
