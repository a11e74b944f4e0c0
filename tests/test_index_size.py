"""Steps of the index that must not grow faster than the documents, and documents that share an id."""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from seekwell.functions import text as X
from seekwell.operators import counting, index, match
from seekwell.plans import catalogue

TEXTS = [(1, "b a b"), (2, "A a c"), (2, "c d"), (None, "x a"), (None, "x"), (3, None), (4, "..."), (5, "a"), (6, " ".join(f"w{i % 700}" for i in range(20_000)))]


def documents(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counts():
    out = {}
    for d, text in TEXTS:
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        out[d] = out.get(d, Counter()) + Counter(words)
    return out


def test_words_are_counted_inside_documents(spark):
    got = index.document_words(documents(spark)).collect()
    assert sorted(map(repr, [(r.doc_id, r.w, r.tf) for r in got])) == sorted(repr((d, w, n)) for d, c in counts().items() for w, n in c.items())
    norms = {d: float(sum(n * n for n in c.values())) for d, c in counts().items()}
    assert all(r.norm == norms[r.doc_id] for r in got)
    assert sorted(r.doc_id for r in got if r.first) == [1, 2, 5, 6]


def test_words_of_single_documents_are_not_shuffled(spark):
    words = index.document_words(documents(spark).where("doc_id <> 2"))
    assert "Exchange hashpartitioning" not in plan_of(words) and "Exchange" not in plan_of(index.normalized(words)).replace("Exchange RoundRobin", "")


def test_norms_come_with_the_words(spark, sf_dir):
    assert "Exchange" not in plan_of(catalogue.QUERIES["ntf_l2"](spark, sf_dir))


def test_search_reads_the_words_once(spark):
    words = index.document_words(documents(spark))
    got = {r.doc_id: r.score for r in match.matches(words, ["a", "C"], None).collect()}
    c = counts()[2]
    n, norm = 4, math.sqrt(sum(x * x for x in c.values()))  # documents with an id and a word
    df = {w: sum(w in x for x in counts().values()) for w in "ac"}
    assert got.keys() == {2} and abs(got[2] - sum(c[w] / norm * math.log(n / df[w]) for w in "ac")) < 2e-8
    found = match.matches(words, ["a"], None)
    assert "Generate" not in plan_of(found)
    plain = words.select("doc_id", "w", "tf")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in match.matches(plain, ["a"], None).collect()}


def test_words_come_from_batches_of_documents(spark, monkeypatch):
    """F5, F8, F9: words are counted in Arrow batches, not by interpreted array functions, and rows come in parts of a
    bounded number, also those of one long document."""
    monkeypatch.setattr(counting, "ROWS_AT_ONCE", 100)
    words = index.document_words(documents(spark).where("doc_id <> 2"))
    assert "MapInArrow" in plan_of(words) and "Generate" not in plan_of(words)
    assert sum(r.doc_id == 6 for r in words.collect()) == 700
    made = list(counting._counter(100)(iter([pa.RecordBatch.from_pydict({"doc_id": [6, None, 7], "text": [TEXTS[-1][1].encode(), b"b a", None]})])))
    assert max(b.num_rows for b in made) <= 100 and sum(b.num_rows for b in made) == 702
    odd = ["İI K9 aéb", "x\x00y_z \U0001f600q", "ß1\n1\t1"]
    table = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    want = table.select("doc_id", F.explode(X.tokens(F.lower("text"), X.WORD)).alias("w")).groupBy("doc_id", "w").count()
    assert sorted(map(tuple, index.document_words(table).select("doc_id", "w", "tf").collect())) == sorted(map(tuple, want.collect()))
