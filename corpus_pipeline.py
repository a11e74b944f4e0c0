"""A training-data pipeline over `documents`: quality rules, language identification, near-duplicates, PII, packing.

Each stage reads what the stage before it kept. All but the last return the columns of `documents`; the last returns
the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekwell.llm import langid, minhash, packing, pii, quality
from seekwell.llm.queries import tokenizer_path
from seekwell.session import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a counting rule or lie far from their language's histograms go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that can be told, go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles, the one with the least id stays."""
    found = minhash.near_duplicates(docs, width=5, percent=80)
    copies = materialize(found.where("NOT kept").select(F.col("doc_id").alias("__copy")).distinct())
    return docs.join(copies, docs["doc_id"] == copies["__copy"], "left_anti")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars follows the new text."""
    replaced = pii.replace(docs, count_col=None)
    return replaced.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else replaced


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near-duplicates", near_duplicates),
    ("PII", private_data),
    ("packing", packed),
]

#: The language model isn't expressible in SQL; tests compare the stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
