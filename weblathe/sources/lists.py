"""Small text inputs: target and cease lists, frames, complaints, field files. All read by Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblathe.functions.parsing import canonical_host
from weblathe.functions.text import lit_array
from weblathe.functions.urls import normalized_target, registrable_domain
from weblathe.functions.vocabulary import BANDS, GEOGRAPHIES, SECTORS

FRAME_COLUMNS = "domain source sector geography popularity_band eligible exclusion_reason".split()
# What every complaint and the probing file must hold.
COMPLAINT_FIELDS = "domain received_at reference scope status".split()
PROBING_FIELDS = "Canonical Contact Description Expires Preferred-Languages".split()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): non-empty lines without comments, in order of the file.

    Lists are files that people write; each is read as one row, so the line number is exact.
    """
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "raw"))
    return rows.select("n", F.trim(F.substring_index("raw", "#", 1)).alias("line")).where("line <> ''")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(position, target, origin, registrable_domain): the first of each target."""
    first = lines(spark, path).groupBy(F.col("line").alias("target")).agg(F.min("n").alias("position"))
    host = F.regexp_extract(normalized_target(F.col("target")), r"//([^:/]+)", 1)
    return first.select("position", "target", normalized_target(F.col("target")).alias("origin"), F.coalesce(registrable_domain(host), host).alias("registrable_domain"))


def read_cease_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain, problem): host names; schemes and wildcards are problems."""
    rows = lines(spark, path).withColumn("domain", canonical_host("line"))
    problem = F.when(F.col("line").contains("://") | F.col("line").startswith("*."), "give host names without scheme or wildcard").when(F.col("domain").isNull(), "not a host name")
    return rows.select("n", "line", F.when(problem.isNull(), F.col("domain")).alias("domain"), problem.alias("problem"))


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    """Frame rows with a problem column; the header must hold exactly the frame's columns, in any order."""
    rows = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if sorted(rows.columns) != sorted(FRAME_COLUMNS):
        raise ValueError(f"the frame's columns must be {FRAME_COLUMNS}, not {rows.columns}")
    return parse_frame(rows)


def parse_frame(rows: DataFrame) -> DataFrame:
    clean = {c: F.lower(F.trim(c)) for c in ("sector", "geography", "popularity_band", "eligible")}
    reason = F.nullif(F.trim("exclusion_reason"), F.lit(""))
    host = canonical_host("domain")
    out = rows.select(registrable_domain(host).alias("domain"), F.trim("source").alias("source"), *(c.alias(n) for n, c in clean.items()), reason.alias("exclusion_reason"))
    problem = (
        F.when(F.col("domain").isNull(), "no registrable domain")
        .when(F.coalesce("source", F.lit("")) == "", "source is empty")
        .when(~F.coalesce(F.col("sector").isin(*SECTORS), F.lit(False)), "unknown sector")
        .when(~F.coalesce(F.col("geography").isin(*GEOGRAPHIES), F.lit(False)), "unknown geography")
        .when(~F.coalesce(F.col("popularity_band").isin(*BANDS), F.lit(False)), "unknown popularity band")
        .when(~F.coalesce(F.col("eligible").isin("true", "false"), F.lit(False)), "eligible must be true or false")
        .when((F.col("eligible") == "true") & F.col("exclusion_reason").isNotNull(), "an eligible domain has an exclusion reason")
        .when((F.col("eligible") == "false") & F.col("exclusion_reason").isNull(), "an ineligible domain needs an exclusion reason")
    )
    return out.withColumn("problem", problem).withColumn("eligible", F.col("eligible") == "true")


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object for each line: (line, missing fields, valid)."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("line"), F.json_object_keys("value").alias("keys"))
    missing = F.array_sort(F.array_except(lit_array(COMPLAINT_FIELDS), F.coalesce("keys", F.array().cast("array<string>"))))
    return rows.select("line", missing.alias("missing"), (F.col("keys").isNotNull() & (F.size(missing) == 0)).alias("valid"))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """Lines "Field: value": (field, value, repeated)."""
    rows = lines(spark, path).select("n", F.trim(F.substring_index("line", ":", 1)).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    return rows.withColumn("repeated", F.count("*").over(Window.partitionBy("field")) > 1)


def probing_problems(spark: SparkSession, path: str) -> DataFrame:
    """One row: missing fields, repeated fields, and whether the file expires in the coming 365 days."""
    fields = read_fields(spark, path)
    grouped = fields.agg(F.collect_set("field").alias("have"), F.array_sort(F.collect_set(F.when(F.col("repeated"), F.col("field")))).alias("repeated"), F.max(F.when(F.col("field") == "Expires", F.col("value"))).alias("expires"))
    until = F.try_to_timestamp("expires")
    timely = F.coalesce((until > F.current_timestamp()) & (until <= F.current_timestamp() + F.expr("interval 365 days")), F.lit(False))
    return grouped.select(F.array_sort(F.array_except(lit_array(PROBING_FIELDS), F.col("have"))).alias("missing"), "repeated", timely.alias("expires_in_time"))
