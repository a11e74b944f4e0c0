"""Ranks, top rows and pages of results without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.session import materialize


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Dense positions from 0 in the order of `keys`, which must tell rows apart. Rows are range-partitioned and written
    with their place in the partition; partition sizes, one row each, give the offsets."""
    run = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    run = materialize(run.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = run.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    return run.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order: each task keeps n, and one merges them."""
    return df.orderBy(*order).limit(n)


def page_of(df: DataFrame, page: int, order: list[Column], size: int = 10) -> DataFrame:
    """Rows (page - 1) * size + 1 to page * size of a result, with their positions."""
    first = top(df, page * size, *order)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > (page - 1) * size)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def last_per(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key, as an aggregate."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
