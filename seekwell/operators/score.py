"""Feature scores of matched documents and their weighted total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.functions.text import safe_ln

#: The weight of a hit by where it stands.
WEIGHTS = {"h": 1.3, "a": 1.2, "p": 1.0}
#: When a tag has as many hits as the query has words, and when it has two or more.
FULL, PARTIAL = 1.5, 1.2


def _weight(tag: Column) -> Column:
    return reduce(lambda rest, k: F.when(tag.startswith(k), F.lit(WEIGHTS[k])).otherwise(rest), WEIGHTS, F.lit(0.0))


def tag_scores(hits: DataFrame) -> DataFrame:
    """(doc_id, tag_score): the mean weight of a document's hits."""
    return hits.groupBy("doc_id").agg((F.sum(_weight(F.col("tag"))) / F.count("*")).alias("tag_score"))


def proximity_scores(hits: DataFrame, words: int) -> DataFrame:
    """(doc_id, proximity_score): over a document's tags, the mean of weight times closeness; 1 for one-word queries."""
    per_tag = hits.groupBy("doc_id", "tag").agg(F.count("*").alias("n"))
    close = F.when((F.col("n") == words) & F.lit(words >= 2), FULL).when(F.col("n") >= 2, PARTIAL).otherwise(1.0)
    score = F.lit(1.0) if words < 2 else F.avg(_weight(F.col("tag")) * close)
    return per_tag.groupBy("doc_id").agg(score.alias("proximity_score"))


def best_contexts(hits: DataFrame) -> DataFrame:
    """(doc_id, tag, context): paragraphs before other headings before h1, of these the tag with the most hits, then the
    one that comes first, and there the first hit's context."""
    rank = F.when(F.col("tag").startswith("p"), 0).when(F.col("tag").startswith("h1"), 2).when(F.col("tag").startswith("h"), 1)
    n = F.count("*").over(Window.partitionBy("doc_id", "tag"))
    rows = hits.withColumns({"rank": rank, "n": n}).where("rank IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("rank", F.desc("n"), "tag", "pos", "word")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("doc_id", "tag", "context")


def highlighted(context: Column, words: list[str]) -> Column:
    """The context with each word of the query bold where it stands, and a mark at its end."""
    bold = lambda text, w: F.replace(text, F.lit(w), F.lit(f"<b>{w}</b>"))
    return F.concat(reduce(bold, words, context), F.lit(" ... "))


def total_scores(features: DataFrame, weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, total_score): sum of coeff * f, or coeff * ln(f) where the weight says so, over a map column `features`.

    Weights (name, coeff, use_log) are few rows; features without one add nothing, repeated ones add twice.
    """
    rows = features.select(id_col, F.explode("features").alias("name", "f")).join(weights, "name", "left")
    value = F.when(F.col("use_log"), safe_ln(F.col("f"))).otherwise(F.col("f"))
    return rows.groupBy(id_col).agg(F.sum(F.coalesce(F.col("coeff") * value, F.lit(0.0))).alias("total_score"))


def ranked(totals: DataFrame, limit: int = 100) -> DataFrame:
    """Best first; NaN before all, then ids."""
    return totals.orderBy(F.desc("total_score"), F.asc("doc_id")).limit(limit)
