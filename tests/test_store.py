"""The stored index, jobs side by side, streams of several batches."""

import datetime

from pyspark.sql import functions as F

from seekwell.functions import text as X
from seekwell.operators import crawl, dataflow, match, store
from seekwell.session import new_folder
from seekwell.streaming import streams


def words(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, w string, tf long")


def test_stored_index_answers_as_the_documents_do(spark, tmp_path):
    rows = [(d, w, 1 + (d * len(w)) % 5) for d in range(60) for w in ("common", "even" if d % 2 == 0 else "odd", f"rare{d % 20}", "\u00e9t\u00e9", "\U0001f600")]
    index = store.build(words(spark, rows), f"{tmp_path}/index", 4)
    for query in (["common"], ["common", "even"], ["even", "odd"], ["common", "rare3"], ["nowhere"], ["common", "\u00e9t\u00e9"]):
        got = sorted(map(tuple, store.matches(index, query).collect()))
        assert got == sorted(map(tuple, match.matches(words(spark, rows), query).collect()))
    read = index.postings(["rare3"])
    assert "PartitionFilters: [isnotnull(shard" in read._jdf.queryExecution().toString() or "shard" in read._jdf.queryExecution().executedPlan().toString()
    assert {X.shard_number(w, 12) for w in ("search", "spark", "Data", "the")} == {8, 5, 6, 9}
    some = spark.createDataFrame([(w,) for _, w, _ in rows], "w string").distinct()
    assert all(r.s == X.shard_number(r.w, 7) for r in some.select("w", X.shard_of(F.col("w"), 7).alias("s")).collect())


def test_index_follows_its_source(spark, tmp_path):
    source, made = f"{tmp_path}/source", []
    make = lambda: made.append(1) or spark.read.parquet(source)
    words(spark, [(1, "a", 1)]).write.parquet(source)
    first = store.stored(spark, source, make)
    assert store.stored(spark, source, make) is first and len(made) == 1
    words(spark, [(2, "b", 1)]).write.mode("append").parquet(source)
    assert {r.w for r in store.stored(spark, source, make).lexicon().collect()} == {"a", "b"} and len(made) == 2


def test_jobs_side_by_side(spark):
    out = dataflow.run_jobs(spark, {"a": lambda: spark.range(10).count(), "b": lambda: 1 // 0, "c": lambda: spark.range(5).count()})
    assert out["a"] == 10 and out["c"] == 5 and isinstance(out["b"], ZeroDivisionError)
    assert dataflow.to_all(spark.range(5), 4)._jdf.queryExecution().analyzed().toString().count("broadcast") == 0


def test_publishing_leaves_out_long_pages(spark):
    pages = spark.createDataFrame([(1, "x" * crawl.PUBLISHED_CHARS), (2, "x" * (crawl.PUBLISHED_CHARS + 1)), (3, "")], "page_id long, html string")
    assert {r.page_id for r in crawl.publishable(pages).collect()} == {1, 3}


def events(spark, rows):
    day = datetime.datetime(2024, 1, 1)
    made = [(i, day + datetime.timedelta(hours=h), u, "view", 1.0, "{}") for i, h, u in rows]
    return spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_late_rows_are_dropped(spark):
    """Four batches; the row of the first day that comes last is later than the watermark allows, which a batch takes from
    the one before the last."""
    folder = new_folder(spark, "late")
    for rows in ([(1, 1, 1), (2, 2, 1)], [(3, 100, 1)], [(6, 101, 1)], [(4, 3, 1), (5, 200, 1)]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.windowed(streams.event_stream(spark, folder, None, 1), ["event_type"], "1 day", None, "1 hour")
    got = {(r.start.day, r.n) for r in streams.run_to_end(stream).collect()}
    assert (1, 2) in got and not any(n == 3 for _, n in got)


def test_replayed_batches_count_once(spark):
    folder = new_folder(spark, "replay")
    batch = spark.createDataFrame([(1, 5)], "worker long, count long")
    for number in (0, 1, 1):
        streams.batch_totals(batch, number, folder)
    assert spark.read.parquet(folder).agg(F.sum("count")).first()[0] == 10
    source = new_folder(spark, "reports")
    events(spark, [(i, i, i % 3) for i in range(12)]).coalesce(1).write.parquet(source)
    told = []
    for _ in range(2):  # started again: the first batch has the same number
        streams.progress(streams.event_stream(spark, source, None, 1), "user_id", 10, told.append, f"{folder}/own")
    assert told == [12, 12]
