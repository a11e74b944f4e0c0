"""The map/reduce surface and the routers of a dataflow, as DataFrame operations.

A job maps each (key, value) to any number of pairs and reduces the values of each key in order. Where built-in
functions can say the same they are faster; these take Python functions for what they can't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seekwell.functions.text import java_hash

Pairs = Iterable[tuple[str, str]]


def map_pairs(df: DataFrame, fn: Callable[[str, str], Pairs]) -> DataFrame:
    """Apply fn(key, value), which yields pairs, to every row of (key, value), in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([p for k, v in zip(batch["key"], batch["value"]) for p in fn(k, v)], columns=["key", "value"])

    return df.select(F.col("key").cast("string"), F.col("value").cast("string")).mapInPandas(run, "key string, value string")


def reduce_pairs(df: DataFrame, fn: Callable[[str, Iterator[str]], Pairs]) -> DataFrame:
    """Apply fn(key, values), which yields pairs, to the values of each key in order. A key's values meet in one task;
    combine before where the reduction allows it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(fn(group["key"].iloc[0], iter(sorted(group["value"])))), columns=["key", "value"])

    return df.groupBy("key").applyInPandas(run, "key string, value string")


def map_reduce(df: DataFrame, mapper: Callable[[str, str], Pairs], reducer: Callable[[str, Iterator[str]], Pairs]) -> DataFrame:
    return reduce_pairs(map_pairs(df, mapper), reducer)


def word_count(lines: DataFrame, value: str = "value") -> DataFrame:
    """(word, n): tokens between white space; an empty token before leading space counts, as splitting gives it."""
    parts = F.split(F.regexp_replace(value, r"\s+$", ""), r"\s+")
    return lines.where(F.length(value) > 0).select(F.explode(parts).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def shuffle(df: DataFrame, n: int) -> DataFrame:
    """Rows in turn to n executors."""
    return df.repartition(n)


def by_fields(df: DataFrame, n: int, *fields: str) -> DataFrame:
    """Rows with equal fields to the same executor."""
    return df.repartition(n, *fields)


def executor_of(n: int, *fields: Column) -> Column:
    """Which of n executors rows with these fields go to: the fields' hashes, exclusive-or, by n."""
    total = F.lit(0).cast("bigint")
    for field in fields:
        total = total.bitwiseXOR(java_hash(field))
    return F.pmod(total, F.lit(n)).cast("int")


def to_first(df: DataFrame) -> DataFrame:
    """All rows to one executor; only for results that are small."""
    return df.coalesce(1)


def to_all(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A copy of every row on every executor, for joins. A table of more than `most` rows isn't copied: joins with it
    shuffle then."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def run_jobs(spark: SparkSession, jobs: dict[str, Callable[[], object]], at_once: int = 4) -> dict[str, object]:
    """Run several jobs side by side, each in a scheduler pool of its own name; with spark.scheduler.mode=FAIR they share
    the executors. Returns what each gives, or the exception that it raised."""

    def run(name: str) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return jobs[name]()
        except Exception as failed:  # one job's failure doesn't end the others
            return failed

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(jobs, pool.map(inheritable_thread_target(run), jobs)))


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`df` with a counter of the rows that pass, readable after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
