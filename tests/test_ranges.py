"""Ranks and running sums over ranges equal the window's, with hot groups split."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from weblathe.operators import ranges


def made(spark, n=4000):
    rng = random.Random(8)
    rows = [(None if i % 17 == 0 else "hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(500) if i % 13 else None, i, None if i % 5 == 0 else rng.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows, "g string, at int, id long, v long").withColumns({"rank": F.lit("mine"), "part": F.lit("kept")})


def test_equal_to_the_window(spark):
    rows = made(spark)
    got = ranges.running(rows, ["g"], ["at", "id"], {"total": F.col("v"), "twice": F.col("v") * 2}, "nth")
    w = Window.partitionBy("g").orderBy(F.col("at").asc_nulls_first(), "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumns({"total": F.sum(F.coalesce("v", F.lit(0))).over(upto), "twice": F.sum(F.coalesce("v", F.lit(0)) * 2).over(upto), "nth": F.row_number().over(w).cast("long")})
    assert got.columns == [*rows.columns, "total", "twice", "nth"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_hot_group_takes_several_tasks(spark):
    rows = made(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these tables are small enough for one task
    sizes = [r["count"] for r in ranges.placed(rows, ["g"], ["at", "id"], "p", "q").groupBy("p").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 0.4 * sum(sizes)
    same = spark.range(4000).select(F.lit("g").alias("g"), F.lit(1).alias("at"))
    sizes = [r["count"] for r in ranges.placed(same, ["g"], ["at"], "p", "q").groupBy("p").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.4 * sum(sizes)
    assert sorted(r["rank"] for r in ranges.running(same, ["g"], ["at"]).collect()) == list(range(1, 4001))


def test_no_rows_and_no_group(spark):
    rows = made(spark, 50)
    assert ranges.running(rows.where("false"), ["g"], ["id"]).count() == 0
    assert [r["rank"] for r in ranges.running(rows, [], ["id"]).orderBy("id").collect()] == list(range(1, 51))
