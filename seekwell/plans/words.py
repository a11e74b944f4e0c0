"""Plain documents: tokens, counts, weights, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.functions import text as X
from seekwell.operators import dataflow, index, store
from seekwell.operators.ranking import global_rank
from seekwell.plans.registry import query
from seekwell.session import table

TOK = """tok AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS w
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE lang = 'en'))"""
DW = TOK + ", dw AS (SELECT doc_id, w, count(*) AS tf FROM tok GROUP BY doc_id, w)"
NTF = DW + ", ntf AS (SELECT doc_id, w, tf, sqrt(tf::double * tf / sum(tf::double * tf) OVER (PARTITION BY doc_id)) AS ntf FROM dw)"
LEX = """lex AS (SELECT w, count(*) AS df, ln((SELECT count(DISTINCT doc_id) FROM dw)::double / count(*)) AS idf FROM dw GROUP BY w)"""
TFIDF = NTF + ", " + LEX


def english_words(spark, d):
    """(doc_id, w, tf, norm, first) of the English documents."""
    return index.document_words(table(spark, d, "documents").where("lang = 'en'"))


def english_index(spark, d):
    """The stored index of the English documents."""
    return store.stored(spark, f"{d}/documents.parquet", lambda: english_words(spark, d))


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(regexp_replace(text, '\s+$', ''), '\s+')) AS word
 FROM documents WHERE length(text) > 0) GROUP BY word""")
def word_count(spark, d):
    return dataflow.word_count(table(spark, d, "documents").select(F.col("text").alias("value")))


@query(r"""SELECT doc_id, (generate_subscripts(t, 1) - 1)::int AS pos, unnest(t) AS w FROM
 (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS t FROM documents)""")
def doc_tokens(spark, d):
    return index.document_tokens(table(spark, d, "documents"), X.TOKEN)


@query(f"WITH {DW} SELECT doc_id, w, tf FROM dw")
def doc_word_tf(spark, d):
    return english_words(spark, d).select("doc_id", "w", "tf")


@query(f"WITH {DW} SELECT w, count(*) AS df FROM dw GROUP BY w")
def lexicon_df(spark, d):
    return index.lexicon(english_words(spark, d))


@query(f"WITH {DW} SELECT w, row_number() OVER (ORDER BY w) - 1 AS word_id FROM (SELECT DISTINCT w FROM dw)")
def word_ids(spark, d):
    return global_rank(index.lexicon(english_words(spark, d)).select("w"), ["w"], "word_id")


@query(f"WITH {NTF} SELECT doc_id, w, tf, round(ntf, 8) AS ntf FROM ntf")
def ntf_l2(spark, d):
    return index.normalized(english_words(spark, d)).select("doc_id", "w", "tf", F.round("ntf", 8).alias("ntf"))


@query(f"WITH {DW}, {LEX} SELECT w, df, round(idf, 8) AS idf FROM lex")
def idf(spark, d):
    words = english_words(spark, d)
    return index.with_idf(index.lexicon(words), words).select("w", "df", F.round("idf", 8).alias("idf"))


@query(f"WITH {TFIDF} SELECT doc_id, ntf.w AS w, round(ntf * idf, 8) AS weight FROM ntf JOIN lex ON ntf.w = lex.w")
def tfidf(spark, d):
    return index.tfidf(english_words(spark, d)).select("doc_id", "w", F.round(F.col("ntf") * F.col("idf"), 8).alias("weight"))


@query(f"""WITH {DW} SELECT doc_id, w, sum(tf)::bigint AS tf FROM (SELECT doc_id, w, count(*) AS tf FROM tok WHERE pos < 50 GROUP BY doc_id, w
 UNION ALL SELECT doc_id, w, count(*) AS tf FROM tok WHERE pos >= 50 GROUP BY doc_id, w) GROUP BY doc_id, w""")
def incremental_index(spark, d):
    """Two runs over different parts of the same documents, merged: the same as one run over all."""
    tokens = index.document_tokens(table(spark, d, "documents").where("lang = 'en'"))
    return index.merged(index.doc_words(tokens.where("pos < 50")), index.doc_words(tokens.where("pos >= 50")))


@query(f"""WITH {DW} SELECT w, unnest(list_distinct([w, upper(w[1:1]) || w[2:], lower(w), upper(w)])) AS variant FROM (SELECT DISTINCT w FROM dw)""")
def case_variants(spark, d):
    return index.lexicon(english_words(spark, d)).select("w", F.explode(X.case_variants(F.col("w"))).alias("variant"))


JAVA_HASH = """list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296)"""
SHARD = "((h - CASE WHEN h >= 2147483648 THEN 4294967296 ELSE 0 END) % 12 + 12) % 12"


@query(f"WITH {DW} SELECT w, ({SHARD})::int AS shard FROM (SELECT w, {JAVA_HASH.format('w')} AS h FROM (SELECT DISTINCT w FROM dw))")
def hit_shard(spark, d):
    return index.lexicon(english_words(spark, d)).select("w", X.shard_of(F.col("w"), 12).alias("shard"))


@query(f"""WITH {DW} SELECT ({SHARD})::int AS shard, count(*) AS words, sum(df)::bigint AS postings
 FROM (SELECT df, {JAVA_HASH.format('w')} AS h FROM (SELECT w, count(*) AS df FROM dw GROUP BY w)) GROUP BY 1""")
def shard_balance(spark, d):
    lex = index.lexicon(english_words(spark, d))
    return lex.groupBy(dataflow.executor_of(12, F.col("w")).alias("shard")).agg(F.count("*").alias("words"), F.sum("df").alias("postings"))


@query(r"""SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies
 FROM (SELECT doc_id, md5(regexp_replace(text, '\s', '', 'g')) AS content_hash FROM documents) GROUP BY 1""")
def content_dedup(spark, d):
    from seekwell.operators.crawl import content_groups

    return content_groups(table(spark, d, "documents"))


@query("""SELECT doc_id, upper(sha256(source)) AS digest, CASE WHEN n_chars > 0 THEN round(ln(n_chars), 8) ELSE '-inf'::double END AS ln_chars,
 contains(lower(text), 'the') AS has_the, text[1:1] ~ '^\\p{Lu}' AS capital FROM documents""".replace("\\\\", "\\").replace("text[1:1] ~ '^\\p{Lu}'", "regexp_matches(text, '^\\p{Lu}')"))
def scalar_functions(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        X.password_digest(F.col("source")).alias("digest"),
        F.round(X.safe_ln(F.col("n_chars")), 8).alias("ln_chars"),
        X.contains_any_case(F.col("text"), F.lit("The")).alias("has_the"),
        (X.is_capitalized(F.col("text")) == 1).alias("capital"),
    )


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id >= 100 AND doc_id < 200")
def key_range_fetch(spark, d):
    from seekwell.sources.io import key_range

    return key_range(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", 100, 200)


@query("SELECT (doc_id % 7)::int AS worker, count(*) AS docs, sum(n_chars)::bigint AS chars FROM documents GROUP BY 1")
def task_assignment(spark, d):
    from seekwell.sources.io import assigned

    return assigned(table(spark, d, "documents"), "doc_id", 7).groupBy("worker").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query(r"""SELECT doc_id::varchar || chr(9) || source || chr(9) || regexp_replace(text, '[\r\n]', '', 'g') AS line FROM documents""")
def tsv_export(spark, d):
    from seekwell.sources.io import tsv_line

    return table(spark, d, "documents").select(tsv_line(F.col("doc_id"), F.col("source"), F.col("text")).alias("line"))


@query("SELECT source, max_by(doc_id, doc_id) AS doc_id, max_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def last_per_key(spark, d):
    from seekwell.operators.ranking import last_per

    rows = table(spark, d, "documents").select("source", "doc_id", F.struct("doc_id", "n_chars").alias("row"))
    return last_per(rows, "source", "row", "doc_id").select("source", "row.*")


@query("""SELECT word AS key, sum(n)::varchar AS value FROM (SELECT lang AS word, 1 AS n FROM documents) GROUP BY word""")
def map_reduce_job(spark, d):
    """The same through Python map and reduce functions."""
    pairs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("value"))
    return dataflow.map_reduce(pairs, lambda k, v: [(v, "1")], lambda k, vs: [(k, str(sum(map(int, vs))))])
