"""Every query against its DuckDB SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from seekwell.plans import catalogue
from seekwell.session import TABLES

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "is_integer") and not isinstance(v, bool) and float(v).is_integer():
        return int(v)
    return float(v) if type(v).__name__ == "Decimal" else v


def sorted_rows(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert df.columns
        return
    found = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted_rows(found.fetchall(), [columns.index(c) for c in sorted(columns)])
    assert sorted_rows(rows, [df.columns.index(c) for c in sorted(columns)]) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_cache_like_a_loop(spark, duck, sf_dir):
    stored, n = {}, {True: 0, False: 0}
    for user, us in duck.execute("SELECT user_id, epoch_us(ts) FROM events ORDER BY ts, event_id").fetchall():
        hit = user in stored and us - stored[user] < 6 * 3600 * 1_000_000
        n[hit] += 1
        if not hit:
            stored[user] = us
    got = {r.hit: r.n for r in catalogue.QUERIES["stream_cache"](spark, sf_dir).collect()}
    assert {k: v for k, v in n.items() if v} == got
