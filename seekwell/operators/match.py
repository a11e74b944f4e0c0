"""Conjunctive keyword match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.functions.text import case_variants
from seekwell.operators import index
from seekwell.operators.ranking import top
from seekwell.session import materialize


def known_words(spark, words: list[str], lex: DataFrame) -> DataFrame:
    """The query's words of which the lexicon has some case variant; others are dropped from the query."""
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    variants = asked.select("word", F.explode(case_variants(F.col("word"))).alias("w"))
    return lex.join(F.broadcast(variants), "w").select("word").distinct()  # a few rows per word asked for


def matches(words: DataFrame, query: list[str], limit: int | None = 100) -> DataFrame:
    """(doc_id, score): documents that hold every word of the query, by the sum of the words' tf-idf; all of them, in no
    order, without a limit.

    Instead of a join per word, postings are filtered to the words and counted per document. `words` is (doc_id, w, tf)
    of the collection, and norm and first if they are known; norms and document frequencies come from all of it, in one
    pass that keeps the postings of the words and one row per document.
    """
    asked = sorted({w.lower() for w in query})
    kept = materialize(index.with_norms(words).where(F.col("w").isin(asked) | F.col("first")))
    few = index.normalized(kept.where(F.col("w").isin(asked)))
    scored = few.join(F.broadcast(index.with_idf(index.lexicon(few), kept)), "w")  # a row per word of the query
    found = scored.groupBy("doc_id").agg(F.round(F.sum(F.col("ntf") * F.col("idf")), 8).alias("score"), F.count_distinct("w").alias("n"))
    found = found.where(F.col("n") == len(asked)).drop("n")
    return found if limit is None else top(found, limit, F.desc("score"), F.asc("doc_id"))
