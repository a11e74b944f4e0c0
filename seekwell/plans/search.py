"""Keyword search over plain documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.operators import index, match, store
from seekwell.plans.registry import query
from seekwell.plans.words import DW, LEX, NTF, TFIDF, english_index, english_words
from seekwell.session import table


def _and(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""WITH {TFIDF} SELECT doc_id, round(sum(ntf * idf), 8) AS score FROM ntf JOIN lex ON ntf.w = lex.w WHERE ntf.w IN ({listed})
 GROUP BY doc_id HAVING count(DISTINCT ntf.w) = {len(words)} ORDER BY score DESC, doc_id LIMIT """


@query(_and(["antion"]) + "100")
def search_single(spark, d):
    return store.matches(english_index(spark, d), ["antion"])


@query(_and(["antion", "retion"]) + "10")
def search_and(spark, d):
    return store.matches(english_index(spark, d), ["antion", "retion"], 10)


@query(f"SELECT doc_id, score, source, n_chars, substring(text, 1, 150) AS title FROM ({_and(['antion', 'retion'])} 100) m JOIN documents USING (doc_id)")
def search_docinfo(spark, d):
    found = store.matches(english_index(spark, d), ["antion", "retion"])
    info = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.substring("text", 1, 150).alias("title"))
    return info.join(F.broadcast(found), "doc_id")  # at most 100 matches


@query(f"""WITH {DW} SELECT word FROM (SELECT unnest(['antion', 'Retion', 'zzzz', 'THE']) AS word)
 WHERE lower(word) IN (SELECT w FROM dw) OR word IN (SELECT w FROM dw)""")
def unknown_word_filter(spark, d):
    return match.known_words(spark, ["antion", "Retion", "zzzz", "THE"], english_index(spark, d).lexicon())


@query(f"""WITH {TFIDF} SELECT doc_id, round(sum(ntf * idf), 8) AS score FROM ntf JOIN lex ON ntf.w = lex.w WHERE ntf.w IN ('antion', 'retion') GROUP BY doc_id HAVING count(DISTINCT ntf.w) = 2""")
def search_without_index(spark, d):
    """All matches straight from the documents, as for a collection that is searched once."""
    return match.matches(english_words(spark, d), ["antion", "retion"], None)


@query(f"WITH {NTF} SELECT w, doc_id, tf, round(ntf, 8) AS ntf FROM ntf WHERE w IN ('Antion', 'antion', 'ANTION')")
def shard_hits(spark, d):
    """The postings of one word's case variants, from the shards that hold them."""
    return store.hits_of(english_index(spark, d), "Antion").select("w", "doc_id", "tf", F.round("ntf", 8).alias("ntf"))


@query(f"""WITH {NTF}, {LEX} SELECT * FROM (SELECT ntf.w AS w, doc_id, round(ntf * idf, 8) AS weight FROM ntf JOIN lex ON ntf.w = lex.w)
 QUALIFY row_number() OVER (PARTITION BY w ORDER BY weight DESC, doc_id) <= 3""")
def best_documents_per_word(spark, d):
    """The three best documents of every word: a champion list."""
    return index.champions(english_words(spark, d), 3)
