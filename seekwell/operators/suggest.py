"""Trending keywords, spelling suggestions, caches and latency figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekwell.functions.text import query_tokens
from seekwell.operators.ranking import top


def keyword_counts(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(keyword, count): how often each token of (query) was searched, of tokens that match something in `known` (w)."""
    tokens = queries.select(F.explode(query_tokens(F.col("query"))).alias("keyword"))
    return tokens.join(known.select(F.col("w").alias("keyword")).distinct(), "keyword", "left_semi").groupBy("keyword").count()


def trending(counts: DataFrame, n: int = 100) -> DataFrame:
    return top(counts, n, F.desc("count"), F.asc("keyword"))


def compat_distance(s: str, t: str) -> int:
    """The edit distance of the original service, which never tries deletions: insertions and substitutions only.

    d(i, j) over suffixes: equal characters cost nothing; else one more than the better of skipping a character of t
    and replacing one. What is left of either string when the other ends counts in full.
    """
    n, m = len(s), len(t)
    row = list(range(m, -1, -1))  # s is used up
    for i in range(n - 1, -1, -1):
        new = [0] * m + [n - i]
        for j in range(m - 1, -1, -1):
            new[j] = row[j + 1] if s[i] == t[j] else 1 + min(new[j + 1], row[j + 1])
        row = new
    return row[0]


@F.pandas_udf(T.IntegerType())
def ref_edit_distance(s: pd.Series, t: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else compat_distance(a, b) for a, b in zip(s, t)], dtype="Int32")


def corrections(tokens: DataFrame, popular: DataFrame, most: int, compat: bool = False) -> DataFrame:
    """(token, suggestion, distance): for each distinct token the nearest of the popular keywords (keyword, count) not
    further than `most`; ties go to the more popular, then the lesser. `popular` is a top-n list, so it is small."""
    distance = ref_edit_distance(F.col("token"), F.col("keyword")) if compat else F.levenshtein("token", "keyword")
    pairs = tokens.select("token").distinct().join(F.broadcast(popular), how="cross").withColumn("distance", distance.cast("int"))
    near = pairs.where(F.col("distance") <= most)
    best = F.min(F.struct("distance", (-F.col("count")).alias("less"), "keyword")).alias("best")
    return near.groupBy("token").agg(best).select("token", F.col("best.keyword").alias("suggestion"), F.col("best.distance").alias("distance"))


def corrected_queries(queries: DataFrame, popular: DataFrame, most: int, compat: bool = False) -> DataFrame:
    """(query_id, query, corrected): each token replaced by its suggestion; queries without any stay as they were."""
    tokens = queries.select("query_id", "query", F.posexplode(query_tokens(F.col("query"))).alias("pos", "token"))
    found = corrections(tokens, popular, most, compat).select("token", "suggestion")
    rows = tokens.join(found, "token", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("suggestion", "token").alias("t"))))
    joined = rows.groupBy("query_id", "query").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("new"), F.count("suggestion").alias("n"))
    fixed = joined.select("query_id", F.when(F.col("n") > 0, F.col("new")).alias("new"))
    return queries.join(fixed, "query_id", "left").select("query_id", "query", F.coalesce("new", "query").alias("corrected"))


def fresh(cache: DataFrame, now_ms: int, ttl_ms: int = 300_000) -> DataFrame:
    """Entries (id, score, last_update) younger than the time to live."""
    return cache.where(F.lit(now_ms) - F.col("last_update") < ttl_ms)


def with_cached_ranks(matches: DataFrame, cache: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds ranker_score: from the cache, else from the ranks, else null."""
    hit = cache.select("doc_id", F.col("score").alias("cached"))
    return matches.join(hit, "doc_id", "left").join(ranks, "doc_id", "left").select(
        matches["*"], F.coalesce("cached", "rank").alias("ranker_score")
    )


def latency(metrics: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, mean, maximum and percentiles of a metric."""
    p = lambda q: F.percentile(value, F.lit(q))
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), p(0.5).alias("p50"), p(0.95).alias("p95")
    )
