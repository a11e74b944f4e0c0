"""Link graphs. Edges come from the sequence of users in `events` and, with nodes that have no links, from document ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.operators import graph
from seekwell.operators.ranking import global_rank, top
from seekwell.plans.registry import query
from seekwell.session import table

USERS = """edges AS (SELECT DISTINCT user_id AS src, nxt AS dst FROM (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)"""
DOCS = """edges AS (SELECT DISTINCT doc_id AS src, unnest([(doc_id * 7 + 3) % n, (doc_id * 13 + 5) % n]) AS dst FROM documents, (SELECT count(*) AS n FROM documents) WHERE doc_id % 7 <> 0)"""
NODES = "nodes AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"


def ranks_sql(edges: str, k: int) -> str:
    parts = [edges, NODES, "shares AS MATERIALIZED (SELECT src, dst, 1.0::double / count(*) OVER (PARTITION BY src) AS share FROM edges)",
             "n AS MATERIALIZED (SELECT count(*)::double AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT id, 1.0::double / n AS rank FROM nodes, n)"]
    for i in range(1, k + 1):
        parts.append(f"""r{i} AS MATERIALIZED (SELECT id, (1 - 0.85::double) / n + 0.85::double * coalesce(got, 0) AS rank FROM nodes CROSS JOIN n
 LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r{i - 1} JOIN shares ON id = src GROUP BY dst) ON id = dst)""")
    return "WITH " + ", ".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{k}"


def user_edges(spark, d):
    """Which user comes after which, an edge for each pair of neighbours in time. Places in the sequence come from
    range partitions, and each event meets the next one by its place, so no task orders all of them."""
    placed = global_rank(table(spark, d, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "at")
    after = placed.select((F.col("at") - 1).alias("at"), F.col("user_id").alias("dst"))
    return placed.select("at", F.col("user_id").alias("src")).join(after, "at").select("src", "dst").distinct()


def doc_edges(spark, d):
    """Two arithmetic links from each document to documents of the whole table; every 7th has none, as SURVEY 7.3 asks."""
    docs = table(spark, d, "documents").select("doc_id")
    linking = docs.where("doc_id % 7 <> 0").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    two = F.explode(F.array((F.col("doc_id") * 7 + 3) % F.col("n"), (F.col("doc_id") * 13 + 5) % F.col("n")))
    return linking.select(F.col("doc_id").alias("src"), two.alias("dst")).distinct()


@query(f"""WITH {USERS}, {NODES} SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS out_degree, (SELECT count(*) FROM edges WHERE dst = id) AS in_degree FROM nodes""")
def graph_degrees(spark, d):
    return graph.degrees(user_edges(spark, d)).select("id", F.col("out_degree").cast("bigint"), F.col("in_degree").cast("bigint"))


@query(ranks_sql(USERS, 10))
def pagerank_k(spark, d):
    return graph.page_rank(user_edges(spark, d), 10).select("id", F.round("rank", 9).alias("rank"))


@query(ranks_sql(DOCS, 10))
def pagerank_dangling(spark, d):
    return graph.page_rank(doc_edges(spark, d), 10).select("id", F.round("rank", 9).alias("rank"))


@query(f"SELECT * FROM ({ranks_sql(USERS, 10)}) ORDER BY rank DESC, id LIMIT 10")
def pagerank_top(spark, d):
    ranks = graph.page_rank(user_edges(spark, d), 10).select("id", F.round("rank", 9).alias("rank"))
    return top(ranks, 10, F.desc("rank"), F.asc("id"))


@query(f"SELECT round(sum(rank), 6) AS mass, count(*) AS nodes FROM ({ranks_sql(DOCS, 10)})")
def pagerank_mass(spark, d):
    return graph.page_rank(doc_edges(spark, d), 10).agg(F.round(F.sum(F.round("rank", 9)), 6).alias("mass"), F.count("*").alias("nodes"))


@query(f"""WITH {DOCS} SELECT src, dst FROM edges WHERE dst IN (SELECT doc_id FROM documents)""")
def edge_resolve(spark, d):
    """Links between URLs as ids; URLs that aren't in the table vanish on both ends."""
    url = lambda c: F.concat(F.lit("http://h:80/"), c.cast("string"))
    links = doc_edges(spark, d).select(url(F.col("src")).alias("from_url"), url(F.col("dst")).alias("to_url"))
    urls = table(spark, d, "documents").select(url(F.col("doc_id")).alias("url"), "doc_id")
    return graph.resolved(links, urls)


@query(f"""WITH {USERS} SELECT src AS doc_id, list_sort(list(dst)) AS to_doc_ids FROM edges GROUP BY src""")
def adjacency(spark, d):
    """Published links: a list of targets for each source."""
    return user_edges(spark, d).groupBy(F.col("src").alias("doc_id")).agg(F.array_sort(F.collect_set("dst")).alias("to_doc_ids"))
