"""Sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell import schemas
from seekwell.functions import url as U
from seekwell.operators.ranking import last_per, top


def read_lines(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """(file, line, value): text files with line numbers from 0, each read whole by one task; `suffix` keeps files whose
    names end so (shards). Where numbers don't matter, `read_text` splits files of any size."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}" if suffix else None).withColumn("file", F.input_file_name())
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n", -1)
    return whole.select("file", F.posexplode(lines).alias("line", "value"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines in any order; Spark splits the files."""
    return spark.read.text(path)


def key_range(df: DataFrame, key: str, begin: int, end: int) -> DataFrame:
    """Rows with begin <= key < end; the condition reaches the scan."""
    return df.where((F.col(key) >= begin) & (F.col(key) < end))


def assigned(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Adds worker: key modulo the number of workers."""
    return df.withColumn("worker", F.pmod(F.col(key), F.lit(workers)).cast("int"))


def with_doc_ids(links: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds doc_id by URL, -1 where it is unknown."""
    return links.join(urls.select(F.col("url").alias(url_col), "doc_id"), url_col, "left").withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


def tsv_line(*columns: Column) -> Column:
    """Columns with tabs between, line breaks removed."""
    return F.concat_ws("\t", *[F.regexp_replace(c.cast("string"), "[\r\n]", "") for c in columns])


def write_lines(df: DataFrame, path: str, *columns: str) -> None:
    df.select(tsv_line(*map(F.col, columns)).alias("value")).write.mode("overwrite").text(path)


def id_url_listing(urls: DataFrame) -> DataFrame:
    """(value): `id<TAB>url` in the order of ids."""
    return urls.orderBy("doc_id").select(F.concat_ws("\t", F.col("doc_id").cast("string"), "url").alias("value"))


def write_last_per_key(pairs: DataFrame, path: str, order: str) -> None:
    """`(key, value)` lines with the last value of each key."""
    last_per(pairs, "key", "value", order).select(F.format_string("(%s, %s)", "key", "value").alias("value")).write.mode("overwrite").text(path)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """A bulk insert: one more set of parquet files."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Stored counts with changes added; keys that are new are inserted."""
    return stored.select(*keys, value).unionByName(changes.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def write_jdbc(df: DataFrame, url: str, table: str, rows_at_once: int = 2000, **properties: str) -> None:
    """Insert into a database table in batches; its driver must be on the class path."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=rows_at_once, **properties).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, table: str, **properties: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **properties).load()


def messages(df: DataFrame) -> DataFrame:
    """Queue messages from a column `value` of JSON: their fields, malformed ones as nulls."""
    return df.select(F.from_json("value", schemas.MESSAGE).alias("m")).select("m.*")


def to_messages(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def read_config(path: str, defaults: dict, read: Callable[[str], str] | None = None) -> dict:
    """A JSON object with defaults for keys it lacks; a missing file gives the defaults."""
    try:
        text = read(path) if read else open(path, encoding="utf-8").read()
    except FileNotFoundError:
        return dict(defaults)
    return defaults | json.loads(text)


def read_list(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small file (keywords, seeds) that aren't blank."""
    return [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(100_000).collect()]


def seeds(df: DataFrame) -> DataFrame:
    return df.select(U.with_scheme(F.col("url")).alias("url"))


def config_value(configs: DataFrame, name: str) -> DataFrame:
    """One row (value): a setting, 0 if it isn't stored."""
    return configs.where(F.col("name") == name).agg(F.coalesce(F.max("value"), F.lit(0)).alias("value"))


def stored_statistics(words: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Row and key counts of an index, and its most frequent entries."""
    totals = words.agg(F.count("*").alias("rows"), F.count_distinct("w").alias("words"), F.count_distinct("doc_id").alias("docs"))
    return totals, top(words, n, F.desc("tf"), F.asc("doc_id"), F.asc("w"))
