"""Ranks and running sums in groups of any size: what a window does, with a hot group split over tasks.

A window sends all rows of a group to one task. Here rows are dealt by ranges of (group, order), so a group
takes as many partitions as its rows need; each partition ranks and sums its own rows, and adds what the group's rows in
the partitions before it come to, a table with a row for each partition and group in it. Rows that agree in group and
order are spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblathe.sources.shared import written


def placed(rows: DataFrame, within: list[str], order: list[str], part: str, place: str) -> DataFrame:
    """``rows`` dealt by ranges and sorted, nulls first, with the number of their partition and their place in it; a written table."""
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in [*within, *order]]
    salt = f"{part} salt"
    spread = rows.withColumn(salt, F.monotonically_increasing_id() % 1024)
    ranged = spread.repartitionByRange(*keys, F.col(f"`{salt}`")).sortWithinPartitions(*keys, F.col(f"`{salt}`")).drop(salt)
    return written(ranged.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "placed")


def running(rows: DataFrame, within: list[str], order: list[str], sums: dict[str, Column] | None = None, rank: str | None = "rank") -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ... in each group, by order) and a running sum, the row itself included, for each of ``sums``.

    ``sums`` are whole numbers or decimals, null counts as 0: equal in any order of adding. Rows that agree in group and order
    are ranked in an order of their own. Columns of the new names are replaced.
    """
    named = {name: F.coalesce(c, F.lit(0)) for name, c in (sums or {}).items()} | ({rank: F.lit(1).cast("long")} if rank else {})
    kept = rows.drop(*(set(named) - {*within, *order}))
    part, place = "of ranges: part", "of ranges: place"
    given = rows.select(*kept.columns, *(c.alias(f"of ranges: {name}") for name, c in named.items()))
    table = placed(given, within, order, part, place)
    value = lambda name: F.col(f"`of ranges: {name}`")
    totals = table.groupBy(part, *within).agg(*(F.sum(value(name)).alias(f"of ranges: {name}") for name in named))
    before = Window.partitionBy(*(F.col(f"`{c}`") for c in within)).orderBy(f"`{part}`").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(part, *within, *(F.coalesce(F.sum(value(name)).over(before), F.lit(0)).alias(f"of ranges: start of {name}") for name in named))
    own = Window.partitionBy(f"`{part}`", *(F.col(f"`{c}`") for c in within)).orderBy(f"`{place}`").rowsBetween(Window.unboundedPreceding, 0)
    inside = table.select(*kept.columns, part, *(F.sum(value(name)).over(own).alias(f"of ranges: {name}") for name in named))
    a, b = inside.alias("a"), starts.alias("b")
    same = F.col(f"a.`{part}`") == F.col(f"b.`{part}`")
    for c in within:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    joined = a.join(b, same)
    return joined.select(*(F.col(f"a.`{c}`") for c in kept.columns), *((F.col(f"a.`of ranges: {name}`") + F.col(f"b.`of ranges: start of {name}`")).alias(name) for name in named))
