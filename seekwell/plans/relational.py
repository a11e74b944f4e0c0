"""Relational extras that Spark brings along: joins of every kind, grouping sets, windows, sets, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seekwell.plans.registry import query
from seekwell.session import table


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc,
 round(avg(l_discount), 8) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 4).alias("sum_disc"),
        F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def join_inner(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return table(spark, d, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def join_full(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'""")
def join_asof(spark, d):
    """The last purchase before each click: a running maximum over both kinds of events, so each user is sorted once."""
    rows = table(spark, d, "events").where("event_type IN ('click', 'purchase')")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    order = Window.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(bought, ignorenulls=True).over(order)
    return rows.withColumn("purchase_id", last).where("event_type = 'click' AND purchase_id IS NOT NULL").select("event_id", "purchase_id")


@query("""SELECT e.event_id, count(*) AS n FROM events e JOIN events o ON o.user_id = e.user_id AND o.ts > e.ts AND o.ts <= e.ts + INTERVAL '1 hour' WHERE e.event_type = 'signup' GROUP BY e.event_id""")
def join_range(spark, d):
    """Events within an hour after a signup: joined by user and hour bin, so no user's rows all meet each other."""
    bins = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 3_600_000_000)
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    left = events.where("event_type = 'signup'").withColumn("bin", F.explode(F.array(bins(F.col("ts")), bins(F.col("ts")) + 1))).alias("e")
    right = events.withColumn("bin", bins(F.col("ts"))).alias("o")
    near = F.expr("o.ts > e.ts AND o.ts <= e.ts + INTERVAL '1' HOUR")
    met = left.join(right, (F.col("e.user_id") == F.col("o.user_id")) & (F.col("e.bin") == F.col("o.bin")) & near)
    return met.groupBy(F.col("e.event_id").alias("event_id")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus)::int AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))


@query("""SELECT o_orderkey, sum(o_totalprice) OVER w AS running, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::int AS place,
 lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""".replace("sum(o_totalprice) OVER w", "round(sum(o_totalprice) OVER w, 2)"))
def window_frames(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(order.rowsBetween(-2, 0)), 2).alias("running"),
        F.rank().over(best).alias("place"), F.lag("o_orderkey").over(order).alias("before"),
    )


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("""SELECT o_orderpriority, "F", "O", "P" FROM (PIVOT (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING count(o_orderkey) GROUP BY o_orderpriority)""")
def pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


@query("SELECT p_brand, quantile_disc(p_size, 0.5) AS median, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
def percentiles(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("median"), F.count_distinct("p_type").alias("types"))


@query("""SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::double * p[2]::double)), 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
 ORDER BY score DESC, vec_id LIMIT 10""")
def vector_similarity(spark, d):
    """The ten vectors with the largest inner product with one query vector."""
    rows = table(spark, d, "embeddings")
    one = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)
