"""Index, scores, graphs, crawl filters, suggestions and the dataflow surface on small golden tables."""

import math

import pytest
from pyspark.sql import functions as F

from seekwell.operators import crawl, dataflow, graph, index, match, score, suggest
from seekwell.operators.ranking import first_per, global_rank, last_per, page_of, top
from seekwell.sources import io


def hits(spark, tags, words=None):
    rows = [(1, (words or ["w"] * len(tags))[i], t, i, 0, f"c{i}") for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "doc_id long, word string, tag string, pos int, cap int, context string")


@pytest.mark.parametrize(
    "tags, k, tag, prox",
    [(["h10", "p0", "p0"], 2, 1.1, 1.4), (["a_4_0"], 1, 1.2, 1), (["p0", "p0", "p0"], 2, 1.0, 1.2), (["h10", "h10", "p1", "a_7_3", "a_7_3"], 2, 1.2, 1.583333)],
)
def test_scores(spark, tags, k, tag, prox):
    h = hits(spark, tags)
    assert score.tag_scores(h).first().tag_score == pytest.approx(tag, abs=1e-6)
    assert score.proximity_scores(h, k).first().proximity_score == pytest.approx(prox, abs=1e-6)


def test_best_context_prefers_paragraphs(spark):
    assert score.best_contexts(hits(spark, ["h10", "h20", "p1", "p0", "p1"])).first().tag == "p1"
    assert score.best_contexts(hits(spark, ["h10", "h21"])).first().tag == "h21"


def test_total_score_unknown_and_repeated_weights(spark):
    f = spark.createDataFrame([(1, {"a": 2.0, "b": 1.0, "c": 5.0})], "doc_id long, features map<string,double>")
    w = spark.createDataFrame([("a", 2.0, False), ("a", 1.0, False), ("b", 3.0, True)], "name string, coeff double, use_log boolean")
    assert score.total_scores(f, w).first().total_score == pytest.approx(6.0)


def test_tfidf_weights(spark):
    words = spark.createDataFrame([(1, "x", 3), (1, "y", 4), *[(i, "z", 1) for i in range(2, 11)], (2, "x", 1)], "doc_id long, w string, tf long")
    got = {(r.doc_id, r.w): r for r in index.tfidf(words).collect()}
    assert (got[1, "x"].ntf, got[1, "y"].ntf) == (pytest.approx(0.6), pytest.approx(0.8))
    assert got[1, "x"].idf == pytest.approx(1.6094379)


def test_index_invariants(spark, sf_dir):
    from seekwell.plans.words import english_words

    rows = index.tfidf(english_words(spark, sf_dir))
    worst = rows.groupBy("doc_id").agg(F.abs(F.sum(F.col("ntf") ** 2) - 1).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-9 and rows.where("idf < 0").isEmpty()


def test_matches_hold_every_word(spark):
    words = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (3, "b", 2), (3, "a", 1), (4, "c", 1)], "doc_id long, w string, tf long")
    assert {r.doc_id for r in match.matches(words, ["A", "b"]).collect()} == {1, 3}
    assert match.matches(words, ["a", "zzz"]).isEmpty()
    assert {r.word for r in match.known_words(spark, ["A", "q"], index.lexicon(words)).collect()} == {"A"}


G4 = [(1, 2), (1, 3), (2, 4), (3, 1), (3, 2), (3, 4), (4, 3)]
G11 = [(2, 3), (3, 2), (4, 1), (4, 2), (5, 2), (5, 4), (5, 6), (6, 2), (6, 5), (7, 2), (7, 5), (8, 2), (8, 5), (9, 2), (9, 5), (10, 5), (11, 5)]


def test_page_rank_golden(spark):
    edges = spark.createDataFrame([*G4, (1, 2)], "src long, dst long")
    ranks = {r.id: r.rank for r in graph.page_rank(edges, 41).collect()}
    want = {1: 0.1386725257, 2: 0.1976083492, 3: 0.3570795026, 4: 0.3066396225}
    assert all(ranks[k] == pytest.approx(v, abs=1e-9) for k, v in want.items()) and sum(ranks.values()) == pytest.approx(1)


def plain_rank(edges, eps=1e-4, d=0.85):
    out, ids = {}, sorted({x for e in edges for x in e})
    for a, b in set(edges):
        out.setdefault(a, set()).add(b)
    r = {i: 1 / len(ids) for i in ids}
    while True:
        new = {i: (1 - d) / len(ids) + d * sum(r[a] / len(bs) for a, bs in out.items() if i in bs) for i in ids}
        change = sum(abs(new[i] - r[i]) for i in ids) / len(ids)
        r = new
        if change < eps:
            return r


def test_page_rank_converges_and_loses_dangling_mass(spark):
    got = {r.id: r.rank for r in graph.page_rank(spark.createDataFrame(G11, "src long, dst long"), epsilon=1e-3).collect()}
    assert got == pytest.approx(plain_rank(G11, 1e-3), abs=1e-12) and sum(got.values()) < 1
    whole = graph.page_rank(spark.createDataFrame(G11, "src long, dst long"), 3, redistribute=True).agg(F.sum("rank")).first()[0]
    assert whole == pytest.approx(1)
    assert graph.page_rank(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_edit_distances(spark):
    cases = {("xcat", "cat"): (4, 1), ("cat", "xcat"): (1, 1), ("hello", "helo"): (2, 1), ("helo", "hello"): (1, 1), ("serach", "search"): (2, 2), ("kitten", "sitting"): (3, 3)}
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string").select("a", "b", suggest.ref_edit_distance("a", "b").alias("c"), F.levenshtein("a", "b").alias("l"))
    assert {(r.a, r.b): (r.c, r.l) for r in df.collect()} == cases


def test_corrected_queries(spark):
    popular = spark.createDataFrame([("search", 5), ("seaech", 9)], "keyword string, count long")
    q = spark.createDataFrame([(1, "serch  now"), (2, "zzzzzzz")], "query_id int, query string")
    assert {r.query_id: r.corrected for r in suggest.corrected_queries(q, popular, 2).collect()} == {1: "search now", 2: "zzzzzzz"}


def test_crawl_filters(spark):
    df = spark.createDataFrame([('<html lang="en-US">',), ('<html lang="EN">',), ("<html>",), ('<html lang="de">',)], "html string")
    got = df.select(crawl.english_page(F.col("html")).alias("i"), crawl.english_page(F.col("html"), False).alias("c")).collect()
    assert [(r.i, r.c) for r in got] == [(True, True), (False, True), (False, True), (False, False)]
    counters = spark.createDataFrame([("a", 1, 9), ("b", 0, 0), ("c", 0, 5), ("d", 10, 10)], "host string, ok long, failed long")
    assert {r.host for r in crawl.bad_hosts(counters, 5, 0.5).collect()} == {"a"}
    links = spark.createDataFrame([(1, i, f"u{i % 5}") for i in range(10)], "from_id long, idx int, url string")
    seen = spark.createDataFrame([("u0",)], "url string")
    assert {r.url for r in crawl.emitted(links, seen, 1).collect()} == {"u1", "u2"}
    assert crawl.emitted(links, seen, 0).count() == 4
    assert spark.range(1).select(crawl.is_html(F.lit(" Text/HTML; x"))).first()[0]


def test_dataflow(spark):
    lines = spark.createDataFrame([(" a b a",), ("b",), ("",)], "value string")
    assert {r.word: r.n for r in dataflow.word_count(lines).collect()} == {"": 1, "a": 2, "b": 2}
    pairs = spark.createDataFrame([("1", "a b a"), ("2", "b")], "key string, value string")
    got = dataflow.map_reduce(pairs, lambda k, v: [(w, "1") for w in v.split()], lambda k, vs: [(k, str(sum(map(int, vs))))])
    assert {r.key: r.value for r in got.collect()} == {"a": "2", "b": "2"}
    seen, counter = dataflow.counted(pairs, "pairs")
    seen.collect()
    assert counter.get["rows"] == 2
    assert dataflow.by_fields(pairs, 3, "key").rdd.getNumPartitions() == 3 and dataflow.to_first(pairs).rdd.getNumPartitions() == 1


def test_ranking(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(20)], "k int, v int")
    assert [r.v for r in global_rank(df.repartition(5), ["v"], "at").orderBy("at").collect()] == list(range(20))
    assert [r.v for r in top(df, 2, F.desc("v")).collect()] == [19, 18]
    assert sorted(r.position for r in page_of(df, 2, [F.asc("v")], 6).collect()) == list(range(7, 13))
    assert first_per(df, ["k"], [F.asc("v")]).count() == 3
    assert {r.k: r.v for r in last_per(df, "k", "v", "v").collect()} == {0: 18, 1: 19, 2: 17}


def test_sources(spark, tmp_path):
    (tmp_path / "in.0").write_text("a\nb\n")
    (tmp_path / "in.1").write_text("c")
    rows = io.read_lines(spark, str(tmp_path), ".0").collect()
    assert [(r.line, r.value) for r in rows] == [(0, "a"), (1, "b")]
    assert io.read_text(spark, str(tmp_path)).count() == 3
    df = spark.createDataFrame([(1, "x\r\ny"), (2, "z")], "id int, content string")
    io.write_lines(df, str(tmp_path / "out"), "id", "content")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1\txy", "2\tz"]
    io.append(df, str(tmp_path / "t"))
    io.append(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert io.read_config(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    (tmp_path / "c.json").write_text('{"b": 2}')
    assert io.read_config(str(tmp_path / "c.json"), {"a": 1}) == {"a": 1, "b": 2}
    pairs = spark.createDataFrame([("k", "1", 1), ("k", "2", 2)], "key string, value string, at int")
    io.write_last_per_key(pairs, str(tmp_path / "last"), "at")
    assert spark.read.text(str(tmp_path / "last")).first()[0] == "(k, 2)"
    back = io.messages(io.to_messages(spark.createDataFrame([("URL", "u", 1, 2)], "type string, url string, worker int, count long"))).first()
    assert tuple(back) == ("URL", "u", 1, 2)
    assert io.with_doc_ids(spark.createDataFrame([("a",), ("b",)], "url string"), spark.createDataFrame([("a", 7)], "url string, doc_id int")).orderBy("url").collect()[1].doc_id == -1
    cfg = spark.createDataFrame([("x", 3)], "name string, value int")
    assert (io.config_value(cfg, "x").first()[0], io.config_value(cfg, "y").first()[0]) == (3, 0)


def test_safe_ln(spark):
    from seekwell.functions.text import safe_ln

    assert spark.range(1).select(safe_ln(F.lit(0.0))).first()[0] == -math.inf
