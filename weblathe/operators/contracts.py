"""The signal catalog as a table, and the export of schemas with a check for drift."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weblathe.functions.vocabulary import SIGNALS


def signal_catalog(spark: SparkSession) -> DataFrame:
    """(ordinal, signal, family) of the 110 signals, in catalog order; a constant table."""
    rows = spark.range(1).select(F.posexplode(F.array(*(F.lit(s) for s in SIGNALS))).alias("ordinal", "signal"))
    return rows.withColumn("family", F.substring_index("signal", ".", 1))


def duplicate_signals(observations: DataFrame) -> DataFrame:
    """(run_id, signal, n) that more than one detector gave; detectors must be disjoint."""
    return observations.groupBy("run_id", "signal").agg(F.count("*").alias("n")).where("n > 1")


def schema_json(schema: StructType) -> str:
    return json.dumps(json.loads(schema.json()), indent=2, sort_keys=True) + "\n"


def schema_drift(schema: StructType, stored: str) -> bool:
    """Whether a stored export differs from the schema in use."""
    return schema_json(schema) != stored
