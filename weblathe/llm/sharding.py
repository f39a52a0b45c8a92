"""Sharding by jump consistent hash (Lamping and Veach, 2014).

A stable key and the shard count alone decide a row's shard; there is no ring table. When one
shard is appended, a share of 1/(n+1) of the keys moves, all of them into the new shard.
The key is an integer id itself (its 64 bits seed the generator) or the 64-bit hash of any other
type. A null key counts as key 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

MULTIPLIER = np.uint64(2862933555777941757)  # fixed by the published algorithm


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, all keys at once; about ln(shards) rounds."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    jump = np.zeros(len(key), dtype=np.int64)
    while live.size:
        bucket[live] = jump[live]
        key[live] = key[live] * MULTIPLIER + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        jump[live] = ((bucket[live] + 1) * scale).astype(np.int64)
        live = live[jump[live] < shards]
    return bucket.astype(np.int32)


def key_bits(df: DataFrame, key: str) -> Column:
    """Integers as they are, other types hashed; null as 0."""
    kind = dict(df.dtypes)[key]
    bits = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    return F.coalesce(F.when(F.col(key).isNotNull(), bits), F.lit(0).cast("long"))


def shard_of(bits: Column, shards: int) -> Column:
    @pandas_udf(IntegerType())
    def assign(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards))

    return assign(bits)


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle. A column already named so is replaced."""
    return df.withColumn(column, shard_of(key_bits(df, key), shards))


def with_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard 0, 1, 2, ... without gaps, no matter how large a shard is.

    Equal rows are counted first, so that a row repeated without end is one row here. Rows are dealt
    over hashed buckets in their shard; a bucket's first slot is the sum of the buckets before it (a
    table of shards x 4,096 rows), its rows are numbered inside it. Order: bucket, then columns.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    text = F.concat_ws(":", *(F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names))
    counted = counted.withColumn("_bucket", F.substring(F.md5(text.cast("binary")), 1, 3))
    sizes = counted.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(starts, [shard, "_bucket"])
        .withColumn("_first", F.col("_start") + F.col("_before"))
    )
    return placed.withColumn(slot, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1))).select(*names, slot)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard, slot, and the shard after one more is appended, for every document.

    Law ``key``. Size is the UTF-8 length plus 1 (null text: 1, checksum 0). Rows that repeat a
    doc_id share its shard; equal rows take neighbouring slots.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    bits = key_bits(rows, "doc_id")
    rows = rows.withColumns({"shard": shard_of(bits, shards), "grown_shard": shard_of(bits, shards + 1)})
    return with_slots(rows).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
