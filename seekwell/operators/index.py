"""The index: tag lines, word hits, postings, term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seekwell.functions import html as H
from seekwell.functions import text as X
from seekwell.functions import url as U
from seekwell.functions.barrier import once
from seekwell.operators.counting import word_counts
from seekwell.operators.ranking import first_per
from seekwell.session import materialize

#: Rows that a broadcast table of ids or words holds at most.
BROADCAST_ROWS = 200_000
#: Parts of the documents whose best rows bound what a word's best documents can be; for more documents than parts, none is left out.
SLOTS = 8


def heading_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, idx, tag, text): headings in document order; the tag joins element and index."""
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(H.headings(F.col("html"))).alias("idx", "h"))
    return rows.select("doc_id", F.lit("h").alias("kind"), "idx", F.concat(F.lit("h"), "h.level", "idx").alias("tag"), F.col("h.text").alias("text"))


def paragraph_lines(pages: DataFrame, most: int | None = 2) -> DataFrame:
    """(doc_id, kind, idx, tag, text): the first `most` paragraphs that aren't blank, or all, blank ones included.
    Indexes count every paragraph."""
    every = F.transform(H.paragraphs(F.col("html")), lambda t, i: F.struct(i.alias("idx"), t.alias("text")))
    chosen = every if most is None else F.slice(F.filter(every, lambda p: p["text"] != ""), 1, most)
    rows = pages.select(F.col("page_id").alias("doc_id"), F.explode(chosen).alias("p"))
    return rows.select("doc_id", F.lit("p").alias("kind"), "p.idx", F.concat(F.lit("p"), F.col("p.idx")).alias("tag"), "p.text")


def anchors(pages: DataFrame) -> DataFrame:
    """(from_id, idx, href, text, url): links with the normal form of what they point to."""
    rows = pages.select(
        F.col("page_id").alias("from_id"),
        F.coalesce(H.base_url(F.col("html")), F.col("url")).alias("base"),
        F.posexplode(H.anchors(F.col("html"))).alias("idx", "a"),
    )
    flat = once(rows.select("from_id", "idx", "a.href", "a.text", "base"), "target", U.resolve(F.col("base"), F.col("href")))
    return flat.select("from_id", "idx", "href", "text", U.normalize(F.col("target")).alias("url"))


def anchor_lines(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Anchor texts credited to the pages they point to; links to pages that `urls` (url, doc_id) lacks vanish."""
    met = links.join(urls, "url")
    tag = F.concat_ws("_", F.lit("a"), "from_id", "idx")
    return met.select("doc_id", F.lit("a").alias("kind"), "idx", tag.alias("tag"), "text")


def url_ids(pages: DataFrame) -> DataFrame:
    """(url, doc_id): the least id of each normal form."""
    rows = pages.select(U.normalize(F.col("url")).alias("url"), F.col("page_id").alias("doc_id")).where("url IS NOT NULL")
    return rows.groupBy("url").agg(F.min("doc_id").alias("doc_id"))


def word_hits(lines: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(doc_id, word, tag, pos, cap, context): a row per token of each line, once per word, document, tag and position.

    Words are lower-cased; a dictionary (word, lemma) maps them further.
    """
    spans = lines.select("doc_id", "tag", "text", F.posexplode(X.token_spans(F.col("text"))).alias("pos", "t"))
    hits = spans.select(
        "doc_id", F.lower("t.w").alias("word"), "tag", "pos",
        X.is_capitalized(F.col("t.w")).alias("cap"), X.context(F.col("text"), F.col("t.at")).alias("context"),
    ).where("length(word) > 0")
    if dictionary is not None:
        hits = hits.join(dictionary, "word", "left").withColumn("word", F.coalesce("lemma", "word")).drop("lemma")
    return hits.dropDuplicates(["word", "doc_id", "tag", "pos"])


def postings(hits: DataFrame) -> DataFrame:
    """(word, doc_id, hits): the hits of a word in a document in order."""
    hit = F.struct("tag", "pos", "cap", "context")
    return hits.groupBy("word", "doc_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


def document_tokens(docs: DataFrame, pattern: str = X.WORD) -> DataFrame:
    """(doc_id, pos, w): the words of plain documents in lower case."""
    return docs.select("doc_id", F.posexplode(X.tokens(F.lower("text"), pattern)).alias("pos", "w"))


def doc_words(tokens: DataFrame) -> DataFrame:
    """(doc_id, w, tf): how often each word occurs; counted before and after one shuffle by both keys."""
    return tokens.groupBy("doc_id", "w").agg(F.count("*").alias("tf"))


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, w, tf, norm, first): how often each word of a document occurs, the sum of its squared counts, and whether
    it is the document's least word (of documents with an id).

    Counted inside the rows, without a shuffle; only rows that share their id meet by words. Which ids these are is found
    at once, from the ids alone."""
    shared = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    n = shared.count()
    alone = docs
    if n:
        shared = materialize(shared)
        shared, same = F.broadcast(shared) if n <= BROADCAST_ROWS else shared, F.col("doc_id").eqNullSafe(F.col("__id"))
        alone = docs.join(shared, same, "left_anti")
    out = word_counts(alone)
    if n:
        met = docs.join(shared, same, "left_semi").select("doc_id", F.explode(X.tokens(F.lower("text"), X.WORD)).alias("w"))
        out = out.unionByName(with_norms(doc_words(met)))
    return out


def with_norms(words: DataFrame) -> DataFrame:
    """Adds norm and first, as `document_words` has them, to (doc_id, w, tf) that lack them."""
    if "norm" in words.columns and "first" in words.columns:
        return words
    own = Window.partitionBy("doc_id")
    norm = F.sum(F.col("tf").cast("double") * F.col("tf")).over(own)
    first = (F.col("w") == F.min("w").over(own)) & F.col("doc_id").isNotNull()
    return words.withColumns({"norm": norm, "first": first})


def normalized(words: DataFrame) -> DataFrame:
    """Adds ntf: tf by the Euclidean norm of the document's counts."""
    tf = F.col("tf").cast("double")
    return with_norms(words).withColumn("ntf", F.sqrt(tf * F.col("tf") / F.col("norm"))).drop("norm", "first")


def lexicon(words: DataFrame) -> DataFrame:
    """(w, df): documents per word."""
    return words.groupBy("w").agg(F.count("*").alias("df"))


def with_idf(lex: DataFrame, words: DataFrame) -> DataFrame:
    """Adds idf = ln(N / df); N is one row. Where first words are marked, N is their number."""
    n = F.count_if("first") if "first" in words.columns else F.count_distinct("doc_id")
    n = words.agg(n.cast("double").alias("n"))
    return lex.crossJoin(F.broadcast(n)).withColumn("idf", F.ln(F.col("n") / F.col("df"))).drop("n")


def by_frequency(lex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The most frequent words of a stored lexicon, at most BROADCAST_ROWS of them, and the rest, whose df has a bound."""
    level = F.length(F.bin("df"))  # df is 2 to the power of level - 1 or more
    least, taken = 1 << 62, 0
    for r in sorted(lex.groupBy(level.alias("level")).count().collect(), reverse=True):
        taken += r["count"]
        if taken > BROADCAST_ROWS:
            break
        least = 1 << (r.level - 1)
    return lex.where(F.col("df") >= least), lex.where(F.col("df") < least)


def with_rare(words: DataFrame, frequent: DataFrame, rare: DataFrame) -> DataFrame:
    """The postings of rare words with what the lexicon says of them: only these are shuffled."""
    return words.join(F.broadcast(frequent.select("w")), "w", "left_anti").join(rare, "w")


def with_lexicon(words: DataFrame, lex: DataFrame) -> DataFrame:
    """Postings joined with a stored lexicon. Frequent words, most of the postings, meet it by broadcast; a frequent word is
    therefore never in one task."""
    frequent, rare = by_frequency(lex)
    often = words.join(F.broadcast(frequent), "w")
    return often if rare.isEmpty() else often.unionByName(with_rare(words, frequent, rare))


def counted(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with norms and their lexicon (w, df, idf), both written once and read from there."""
    stored = materialize(with_norms(words))
    return stored, materialize(with_idf(lexicon(stored), stored))


def tfidf(words: DataFrame) -> DataFrame:
    """(w, doc_id, tf, ntf, df, idf)."""
    return normalized(with_lexicon(*counted(words))).select("w", "doc_id", "tf", "ntf", "df", "idf")


def champions(words: DataFrame, n: int = 3) -> DataFrame:
    """(w, doc_id, weight): the n best documents of every word by tf-idf of 8 decimals, then by id, nulls last.

    Rows of frequent words that can't be among the n are left out before anything is sorted: documents are dealt into
    SLOTS, and of the best row of each slot the nth best bounds the nth best of all. Rows are compared by one number, in
    which weight and id both stand, so equal weights don't pile up."""
    stored, lex = counted(words)
    frequent, rare = by_frequency(lex)
    weigh = lambda rows, *more: normalized(rows).select("w", "doc_id", F.round(F.col("ntf") * F.col("idf"), 8).alias("weight"), *more)
    units = F.round(F.col("weight") * 10**8).cast("decimal(12,0)")
    below = F.coalesce(F.lit(2**63 - 1).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)"), F.lit(-1).cast("decimal(20,0)"))
    place = (units * F.lit(str(2**64)).cast("decimal(20,0)") + below).cast("decimal(38,0)")
    often = weigh(stored.join(F.broadcast(frequent), "w"), "idf").select("w", "idf", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot"), place.alias("place"))
    best = [F.max(F.when(F.col("slot") == i, F.col("place"))) for i in range(SLOTS)]
    bars = materialize(often.groupBy("w", "idf").agg(F.get(F.sort_array(F.array(*best), asc=False), F.lit(n - 1)).alias("bar")))
    kept = weigh(stored.join(F.broadcast(bars), "w"), "bar").where(F.col("bar").isNull() | (place >= F.col("bar"))).drop("bar")
    rows = kept if rare.isEmpty() else kept.unionByName(weigh(with_rare(stored, frequent, rare)))
    return first_per(rows, ["w"], [F.desc("weight"), F.asc_nulls_last("doc_id")], n)


def merged(*runs: DataFrame) -> DataFrame:
    """Counts of several runs over different lines of the same documents, added up; df is then counted afresh."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.groupBy("doc_id", "w").agg(F.sum("tf").alias("tf"))
