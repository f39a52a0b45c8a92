"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Stands for a null document id inside an operator: null ids order after all others.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a single-JVM session may do without that setting; it gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="weblathe-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weblathe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` doesn't have, whatever its own columns are called."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while taken & {(n + tail).lower() for n in names}:
        tail += "_"
    return [n + tail for n in names]


def numbered(rows: DataFrame, within: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``index`` 0, 1, 2, ... in each group of ``within``, by ``order``, nulls first.

    Range partitions are written with each row's place; the rows of a group in the partitions before
    are added. Equal rows are spread by a salt, so no partition must hold all copies of a row.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*within, *order]]
    spread = rows.withColumn("_salt", F.monotonically_increasing_id() % 1024)
    ranged = spread.repartitionByRange(*keys, F.col("_salt")).sortWithinPartitions(*keys, "_salt").drop("_salt")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(ranged.withColumns({"_part": F.spark_partition_id(), "_place": place}), label)
    groups = placed.groupBy("_part", *within).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    a, b = placed.alias("a"), starts.alias("b")
    same = F.col("a._part") == F.col("b._part")
    for c in within:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    index = (F.col("_place") - F.col("_first") + F.col("_start")).alias("index")
    return a.join(b, same).select(*(F.col(f"a.{c}") for c in rows.columns), index)


def id_or_last(column: str = "doc_id") -> Column:
    """The id as a long, null as the largest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def null_if_last(column: Column) -> Column:
    return F.when(column != NULL_ID, column)


def byte_rows(column: pa.Array) -> list[bytes]:
    """The values of a string or binary Arrow column as bytes; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    return [value or b"" for value in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sliding_argmin(values: np.ndarray, width: int, block: int = 1 << 24) -> np.ndarray:
    """For each window of ``width`` values, the index of its leftmost least value (upper 40 bits compared).

    Values and indices share one 64-bit key, so longer arrays go in overlapping blocks.
    """
    if len(values) > block:
        starts = range(0, len(values) - width + 1, block - width + 1)
        return np.concatenate([begin + sliding_argmin(values[begin : begin + block], width, block) for begin in starts])
    low = np.uint64((1 << 24) - 1)
    key = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if width > step:
        rest = width - step
        key = np.minimum(key[: len(key) - rest], key[rest:])
    return (key & low).astype(np.int64)
