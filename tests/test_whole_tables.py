"""Queries on tables larger than sf0.001, where a cut would show."""

import datetime

import duckdb

from seekwell.plans import catalogue


def test_document_graphs_grow_with_the_table(spark, tmp_path):
    ids = [*range(299), 1000]  # 299 is linked to and isn't there
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    edges = {(i, t % 300) for i in ids if i % 7 for t in (i * 7 + 3, i * 13 + 5)}
    assert any(b == 299 for _, b in edges)
    nodes = {x for e in edges for x in e}
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path))
    out, ranks = {a: [t for s, t in edges if s == a] for a, _ in edges}, dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(10):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, targets in out.items():
            for b in targets:
                new[b] += 0.85 * ranks[a] / len(targets)
        ranks = new
    got = {r.id: r["rank"] for r in run("pagerank_dangling").collect()}
    assert set(got) == nodes and all(abs(got[k] - ranks[k]) < 2e-9 for k in nodes)
    mass = run("pagerank_mass").first()
    assert mass.nodes == len(nodes) and abs(mass.mass - sum(ranks.values())) < 2e-6
    assert {tuple(r) for r in run("edge_resolve").collect()} == {(a, b) for a, b in edges if a in ids and b in ids}


def test_full_search_ranks_every_match(spark, tmp_path):
    """Pages beyond the first 100 by tf-idf alone have the best tags."""
    page = '<html lang="en"><head><title>Page {}</title></head><body>{}</body></html>'
    short, long = "<p>that for</p>", "<h1>That for</h1><p>that for " + "many other words " * 20 + "</p>"
    bodies = [short] * 120 + [long] * 10 + ["<p>nothing here</p>"]
    rows = [(i, f"http://h/{i}", page.format(i, b)) for i, b in enumerate(bodies)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.doc_id: r.total_score for r in catalogue.QUERIES["full_search"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {r[0]: r[3] for r in con.execute(catalogue.ORACLES["full_search"]).fetchall()}
    assert set(range(120, 130)) < set(want) and len(want) == 20
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-8 for k in want)


def test_http_dates_of_every_event(spark, tmp_path):
    spark.range(1200).selectExpr("id AS event_id", "timestamp_ntz '2024-01-31 23:59:58.5' + make_dt_interval(0, 0, 0, id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.seen for r in catalogue.QUERIES["http_dates"](spark, str(tmp_path)).collect()}
    first = datetime.datetime(2024, 1, 31, 23, 59, 58)
    assert got == {i: first + datetime.timedelta(seconds=i) for i in range(1200)}
