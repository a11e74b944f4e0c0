"""Building the stored index: one pass over the words, one shuffle of postings in tasks of bounded size."""

import math
from collections import Counter

from pyspark.sql import functions as F

from seekwell.functions import text as X
from seekwell.operators import index, match, store
from seekwell.operators.ranking import first_per

ROWS = [(d, w, 1 + (d * len(w)) % 5) for d in range(60) for w in ("common", "even" if d % 2 == 0 else "odd", f"rare{d % 20}", f"only{d}")]


def words(spark):
    return spark.createDataFrame(ROWS, "doc_id long, w string, tf long")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_made_once(spark, tmp_path):
    """the sampling of ranges, the postings and the lexicon all read the words as they were written."""
    made = spark.sparkContext.accumulator(0)

    def count(row):
        made.add(1)
        return row

    rows = spark.createDataFrame(words(spark).rdd.map(count), "doc_id long, w string, tf long")
    store.build(rows, f"{tmp_path}/index", 4)
    assert made.value == len(ROWS)


def test_tasks_sort_a_bounded_number_of_postings(spark, tmp_path, monkeypatch):
    """however few shuffle partitions there are, and a frequent word is spread over several files."""
    monkeypatch.setattr(store, "TASK_ROWS", 20)
    built = store.build(words(spark), f"{tmp_path}/index", 4)
    files = spark.read.parquet(f"{built.path}/postings").groupBy(F.input_file_name().alias("f")).count().collect()
    assert sum(r["count"] for r in files) == len(ROWS) and max(r["count"] for r in files) <= 60 and len(files) >= 8
    got = store.hits_of(built, "common").select("w", "doc_id", "tf", F.round("ntf", 8).alias("ntf")).collect()
    want = index.normalized(words(spark)).where("w = 'common'").select("w", "doc_id", "tf", F.round("ntf", 8).alias("ntf")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 60
    assert built.postings(["common"]).select(F.input_file_name()).distinct().count() > 1


def test_weights_of_frequent_and_rare_words(spark, monkeypatch):
    """frequent words meet the lexicon by broadcast, others by shuffle, and every posting is there once."""
    monkeypatch.setattr(index, "BROADCAST_ROWS", 3)
    rows = index.tfidf(words(spark))
    plan = plan_of(rows)
    assert "Window" not in plan and "Union" in plan and "BroadcastHashJoin" in plan
    df, norms = Counter(w for _, w, _ in ROWS), Counter()
    for d, _, tf in ROWS:
        norms[d] += tf * tf
    got = {(r.doc_id, r.w): r for r in rows.collect()}
    assert len(got) == rows.count() == len(ROWS)
    for d, w, tf in ROWS:
        r = got[d, w]
        assert (r.tf, r.df) == (tf, df[w])
        assert abs(r.ntf - tf / math.sqrt(norms[d])) < 1e-12 and abs(r.idf - math.log(60 / df[w])) < 1e-12


def test_champions_of_words_with_many_equal_weights(spark, monkeypatch):
    """few rows of a frequent word are left to sort, also where weights are equal, and the ids decide."""
    monkeypatch.setattr(index, "BROADCAST_ROWS", 4)
    sorted_rows = []
    monkeypatch.setattr(index, "first_per", lambda df, *more: sorted_rows.append(df) or first_per(df, *more))
    ids = [None, -5, 2**62, *range(397)]
    rows = [(d, w, 1) for d in ids for w in ("every", "half" if (d or 0) % 2 else "other")] + [(d, f"rare{(d or 0) % 50}", 2) for d in ids] + [(7, "most", 1), (8, "most", 9)]
    tables = spark.createDataFrame(rows, "doc_id long, w string, tf long")
    got = index.champions(tables)
    weights = index.tfidf(tables).select("w", "doc_id", F.round(F.col("ntf") * F.col("idf"), 8).alias("weight")).collect()
    want = {}
    for r in sorted(weights, key=lambda r: (-r.weight, r.doc_id is None, r.doc_id or 0)):
        want.setdefault(r.w, []).append(tuple(r))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(t) for found in want.values() for t in found[:3])
    left = {r.w: r["count"] for r in sorted_rows[0].groupBy("w").count().collect()}
    assert left["every"] <= 40 and left["half"] <= 40 and len(want["every"]) == 400


def test_known_words_leave_the_lexicon_where_it_is(spark):
    """the few variants go to the lexicon, not the lexicon to them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lex = spark.range(1000).select(F.concat(F.lit("w"), "id").alias("w"), F.lit(1).alias("df"))
        found = match.known_words(spark, ["W3", "w3", "w2000", "x", "w7"], lex)
        plan = plan_of(found)
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r.word for r in found.collect()) == ["W3", "w3", "w7"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lexicon_needs_no_postings(spark, tmp_path):
    """asking for words orders no postings; the first search does, from the words as they were counted."""
    source = f"{tmp_path}/source"
    words(spark).write.parquet(source)
    built = store.stored(spark, source, lambda: spark.read.parquet(source))
    assert match.known_words(spark, ["Common", "no"], built.lexicon()).count() == 1 and built.pending is not None
    assert store.hits_of(built, "common").count() == 60 and built.pending is None
    assert store.stored(spark, source, lambda: 1 / 0) is built


def test_search_orders_postings_once(spark, tmp_path, monkeypatch):
    """an index built for one search serves the next, and neither goes back to the words' source."""
    source, made = f"{tmp_path}/source", []
    words(spark).write.parquet(source)
    finished = store.Store.finish
    monkeypatch.setattr(store.Store, "finish", lambda self: made.append(self.pending is not None) or finished(self))
    found = [store.matches(store.stored(spark, source, lambda: spark.read.parquet(source)), ["common", w], None) for w in ("even", "rare3")]
    assert [sum(1 for _ in f.collect()) for f in found] == [30, 3] and made == [True, False]
    assert not any(f"{source}/" in name for f in found for name in f.inputFiles())


def test_postings_are_placed_without_a_join(spark, tmp_path, monkeypatch):
    """a posting's shard comes from its word, by Java's own hash, so the lexicon isn't joined or shuffled for it."""
    some = ["", "a", "the", "été", "\U0001f600", "x\U0001f600y", "w" * 300, *(f"rare{i}" for i in range(500))]
    table = spark.createDataFrame([(w,) for w in some] + [(None,)], "w string")
    got = table.select("w", F.pmod(X.jvm_hash(F.col("w")), F.lit(12)).alias("s"), X.shard_of(F.col("w"), 12).alias("old")).collect()
    assert all(r.s == r.old == (None if r.w is None else X.shard_number(r.w, 12)) for r in got)
    monkeypatch.setattr(index, "with_lexicon", lambda *_: 1 / 0)
    built = store.build(words(spark), f"{tmp_path}/index", 4)
    placed = spark.read.parquet(f"{built.path}/postings").select("w", "shard").collect()
    assert len(placed) == len(ROWS) and all(r.shard == X.shard_number(r.w, 4) for r in placed)
