"""Seeded stratified sampling of a frame, and the estimators that go with it.

The order inside a stratum is that of sha256(seed, NUL, domain), so the sample depends on the frame
alone, not on row order or partitions. Frame columns: domain, sources (array), sector, geography,
popularity_band, eligible, exclusion_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.operators import ranges

STRATUM = ("sector", "geography", "popularity_band")
ATTRIBUTES = (*STRATUM, "eligible", "exclusion_reason")


def sample_key(seed: str, domain: str = "domain") -> Column:
    return F.sha2(F.concat(F.lit(seed), F.char(F.lit(0)), F.col(domain)).cast("binary"), 256)


def merge_frame(rows: DataFrame) -> DataFrame:
    """One row for each domain with the sorted union of its sources; ``conflict`` where other attributes differ."""
    same = F.count_distinct(F.to_json(F.struct(*ATTRIBUTES))) > 1
    return rows.groupBy("domain").agg(F.array_sort(F.collect_set("source")).alias("sources"), *(F.min(a).alias(a) for a in ATTRIBUTES), same.alias("conflict"))


def select_sample(frame: DataFrame, seed: str, per_stratum: int) -> DataFrame:
    """The frame with random_order (null if ineligible), stratum_size, selected and inclusion_probability.

    Sizes are sums combined before the shuffle and joined back; a stratum is ranked over ranges, so it may hold any share of the frame.
    """
    eligible = frame.where("eligible")
    ranked = ranges.running(eligible.select("domain", *STRATUM, sample_key(seed).alias("_key")), list(STRATUM), ["_key", "domain"], rank="random_order").withColumn("random_order", F.col("random_order").cast("int"))
    sizes = eligible.groupBy(*STRATUM).agg(F.count("*").alias("stratum_size"))
    drawn = ranked.join(sizes, list(STRATUM)).select("domain", "random_order", "stratum_size")
    out = frame.join(drawn, "domain", "left")
    selected = F.coalesce(F.col("random_order") <= per_stratum, F.lit(False))
    chance = F.when(F.col("eligible"), F.least(F.lit(per_stratum), F.col("stratum_size")) / F.col("stratum_size")).otherwise(0.0)
    return out.withColumns({"stratum_size": F.coalesce("stratum_size", F.lit(0).cast("long")), "selected": selected, "inclusion_probability": chance})


def strata(frame: DataFrame, per_stratum: int) -> DataFrame:
    """frame_size and selected_size of each stratum of eligible domains."""
    return frame.where("eligible").groupBy(*STRATUM).agg(F.count("*").alias("frame_size")).withColumn("selected_size", F.least(F.lit(per_stratum).cast("long"), F.col("frame_size")))


def manifest(selection: DataFrame, seed: str, per_stratum: int) -> DataFrame:
    """The header row of a selection: seed, sizes, and all sources in order."""
    sources = selection.select(F.explode("sources").alias("s")).agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))
    sizes = selection.agg(F.count("*").alias("frame_size"), F.count_if("eligible").alias("eligible_size"), F.count_if("selected").alias("selected_size"))
    parts = sizes.unionByName(sources, allowMissingColumns=True)  # one row each
    return parts.agg(*(F.max(c).alias(c) for c in parts.columns)).select(F.lit(seed).alias("seed"), F.lit(per_stratum).alias("per_stratum"), "frame_size", "eligible_size", "selected_size", "sources")


def panel_split(selection: DataFrame, panel_tenths: int = 8) -> DataFrame:
    """Of each stratum's selection the first 80 % by random order are the panel, the others refresh it."""
    size = F.count("*").over(Window.partitionBy(*STRATUM))
    return selection.where("selected").withColumn("part", F.when(F.col("random_order") * 10 <= size * panel_tenths, "panel").otherwise("refresh"))


def design_means(sampled: DataFrame, value: str) -> DataFrame:
    """Design-weighted mean of ``value`` over selected rows with its standard error (finite population correction)."""
    by = sampled.where("selected").groupBy(*STRATUM, "stratum_size").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))
    size, n = F.col("stratum_size"), F.col("n")
    total = F.sum(size)
    spread = F.sum(size * size * (1 - n / size) * F.col("variance") / n)
    return by.agg(F.sum(n).alias("n"), total.alias("population"), (F.sum(size * F.col("mean")) / total).alias("weighted_mean"), (F.sqrt(spread) / total).alias("standard_error"))


def quality_gates(completed: DataFrame, overall: float = 0.9, each: float = 0.75, sparse_below: int = 5) -> DataFrame:
    """Completion of each stratum and overall (rows with ``complete``) against the gates; sparse strata can't fail."""
    grouped = completed.groupingSets([[], list(STRATUM)], *STRATUM).agg(F.count("*").alias("n"), F.count_if("complete").alias("complete"), F.grouping("sector").alias("_all"))
    share = F.col("complete") / F.col("n")
    passed = F.when(F.col("_all") == 1, share >= overall).otherwise((F.col("n") < sparse_below) | (share >= each))
    return grouped.select(F.when(F.col("_all") == 1, "overall").otherwise(F.concat_ws("/", *STRATUM)).alias("stratum"), "n", "complete", share.alias("share"), passed.alias("passed"))
