"""Public-suffix rules as a table: registrable domains, sites and pacing keys by rules of any depth.

A rule is a line of a suffix list: ``co.uk``, a wildcard ``*.ck`` (any one label before it is part of
the suffix) or an exception ``!www.ck`` (which is none). The longest rule that fits a host wins, an exception over
all others. Rules are joined by name, one equi-join for each depth that the rules have, so hosts aren't
exploded and rows stay where they are: Spark broadcasts the levels as long as their size allows, and shuffles by the
name beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions.parsing import canonical_host
from weblathe.functions.urls import last_labels, registrable_of, suffix_labels


def parse_rules(lines: DataFrame) -> DataFrame:
    """name, depth, plain, wildcard, exception, problem: from ``rule`` lines. Comments (//) and blank lines are left out; what
    follows a blank in a line doesn't count. One row for each name; a line that is no rule keeps its own, with a problem."""
    text = F.regexp_extract("rule", r"^\s*(\S*)", 1)
    rows = lines.select(F.lower(text).alias("rule")).where("rule <> '' and not startswith(rule, '//')")
    bare = F.regexp_replace("rule", r"^(\*\.|!)", "")
    rows = rows.select("rule", canonical_host(bare).alias("name"))
    odd = F.when(F.col("name").isNull(), "not a suffix rule").when(F.col("rule").startswith("!") & ~F.col("name").contains("."), "an exception needs two labels")
    rows = rows.withColumn("problem", odd).withColumn("name", F.when(odd.isNull(), F.col("name")).otherwise(F.col("rule")))
    grouped = rows.groupBy("name", "problem").agg(
        F.bool_or(~F.col("rule").startswith("*.") & ~F.col("rule").startswith("!")).alias("plain"), F.bool_or(F.col("rule").startswith("*.")).alias("wildcard"), F.bool_or(F.col("rule").startswith("!")).alias("exception")
    )
    return grouped.select("name", F.size(F.split("name", r"\.")).alias("depth"), "plain", "wildcard", "exception", "problem")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a suffix-list file; a line that is no rule fails the job."""
    rules = parse_rules(spark.read.text(path).withColumnRenamed("value", "rule"))
    bad = F.raise_error(F.concat(F.col("problem"), F.lit(": "), F.col("name")))
    return rules.withColumn("name", F.when(F.col("problem").isNotNull(), bad.cast("string")).otherwise(F.col("name"))).drop("problem")


def with_suffix_labels(rows: DataFrame, host: str, rules: DataFrame, column: str, unlisted: bool = True) -> DataFrame:
    """``rows`` with the number of labels of each host's public suffix; 0 if there is none.

    ``unlisted``: a last label that no rule names is a suffix. The names of helper columns are not to be
    had by a table: they hold ``column``, which is replaced.
    """
    if column in rows.columns:
        rows = rows.drop(column)
    depth = rules.agg(F.max("depth")).first()[0] or 0  # the labels of the longest rule
    out, names = rows, rows.columns
    found: dict[int, Column] = {}
    for d in range(1, depth + 1):
        key, rule = f"{column} name {d}", f"{column} rule {d}"
        level = rules.where(F.col("depth") == d).select(F.col("name").alias(key), F.struct("plain", "wildcard", "exception").alias(rule))
        out = out.withColumn(key, last_labels(F.col(f"`{host}`"), d)).join(level, key, "left")
        found[d] = F.col(f"`{rule}`")
    n = F.size(F.split(F.col(f"`{host}`"), r"\."))
    has = lambda d, kind: F.coalesce(found[d][kind], F.lit(False)) if d in found else F.lit(False)
    labels = suffix_labels(n, depth, has, unlisted)
    return out.select(*(F.col(f"`{c}`") for c in names), labels.alias(column))


def with_registrable(rows: DataFrame, host: str, rules: DataFrame, column: str = "registrable_domain", unlisted: bool = True) -> DataFrame:
    """``rows`` with the suffix and one label before it; null for a suffix itself, an address or a null host."""
    labelled = with_suffix_labels(rows, host, rules, column, unlisted)
    return labelled.withColumn(column, registrable_of(F.col(f"`{host}`"), F.col(f"`{column}`")))


def with_politeness_key(rows: DataFrame, host: str, rules: DataFrame, column: str = "politeness_key", unlisted: bool = True) -> DataFrame:
    """``rows`` with the registrable domain, or the host where there is none: what requests are paced by."""
    found = with_registrable(rows, host, rules, column, unlisted)
    return found.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.col(f"`{host}`")))


def with_same_site(rows: DataFrame, first: str, second: str, rules: DataFrame, column: str = "same_site", unlisted: bool = True) -> DataFrame:
    """``rows`` with whether two hosts share their politeness key."""
    found = with_politeness_key(with_politeness_key(rows, first, rules, f"{column} of first", unlisted), second, rules, f"{column} of second", unlisted)
    same = F.col(f"`{column} of first`") == F.col(f"`{column} of second`")
    return found.withColumn(column, same).drop(f"{column} of first", f"{column} of second")
