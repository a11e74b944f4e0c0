"""Link graphs: degrees and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.session import materialize

DAMPING, EPSILON, MOST_ITERATIONS = 0.85, 1e-12, 1000
#: Iterations between written results, so that plans and lineage stay short.
WRITE_EVERY = 5


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) over distinct edges, nodes without one of them included."""
    e = edges.distinct()
    both = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def page_rank(
    edges: DataFrame, iterations: int | None = None, damping: float = DAMPING, epsilon: float = EPSILON, redistribute: bool = False
) -> DataFrame:
    """(id, rank) of every node of `edges` (src, dst).

    Ranks start at 1/N; each round a node gets (1 - damping)/N and damping times the shares of the nodes that link to
    it, over distinct links. What nodes without links hold is lost unless `redistribute`. A fixed number of rounds, or
    as many as it takes until the mean change is below `epsilon`. Shares are summed before they are shuffled, so a node
    with very many links in needs no special care.
    """
    e = edges.distinct()
    out = e.groupBy("src").agg(F.count("*").alias("links"))
    e = materialize(e.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("links")).alias("share")))
    every = materialize(nodes(e))
    n = every.count()
    if not n:
        return every.withColumn("rank", F.lit(0.0))
    ranks = every.withColumn("rank", F.lit(1.0 / n))
    for k in range(1, (iterations or MOST_ITERATIONS) + 1):
        got = ranks.join(e, ranks["id"] == e["src"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = F.lit((1 - damping) / n)
        if redistribute:
            lost = ranks.join(e, ranks["id"] == e["src"], "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
            base = F.lit((1 - damping) / n + damping * lost / n)
        new = every.join(got, every["id"] == got["dst"], "left").select("id", (base + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if iterations is None:
            new = materialize(new)
            change = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.avg(F.abs(F.col("rank") - F.col("old")))).first()[0]
            ranks = new
            if change < epsilon:
                break
        else:
            ranks = materialize(new) if k % WRITE_EVERY == 0 else new
    return ranks


def resolved(links: DataFrame, urls: DataFrame) -> DataFrame:
    """(src, dst): links between URLs as ids; links from or to unknown URLs vanish."""
    return (
        links.join(urls.select(F.col("url").alias("from_url"), F.col("doc_id").alias("src")), "from_url")
        .join(urls.select(F.col("url").alias("to_url"), F.col("doc_id").alias("dst")), "to_url")
        .select("src", "dst")
        .distinct()
    )
