"""What surrounds search: trending, spelling, caches, metrics, host behaviour. `events` stands for the query log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seekwell.operators import crawl, suggest
from seekwell.plans.registry import query
from seekwell.plans.words import DW, english_words
from seekwell.operators import index
from seekwell.session import table

#: A query log: the item and event types as search terms.
LOG = "log AS (SELECT event_id, event_type || ' item' || (event_id % 40) || '  the' AS query FROM events)"
ITEMS = "('the', 'antion', 'view', 'error')"


def query_log(spark, d):
    item = (F.col("event_id") % 40).cast("string")
    return table(spark, d, "events").select(
        F.col("event_id").alias("query_id"), F.concat(F.col("event_type"), F.lit(" item"), item, F.lit("  the")).alias("query")
    )


@query("WITH " + LOG + """, tok AS (SELECT unnest(list_filter(string_split(query, ' '), lambda t: trim(t) <> '')) AS keyword FROM log)
 SELECT keyword, count(*) AS count FROM tok WHERE keyword <> 'signup' GROUP BY keyword ORDER BY count DESC, keyword LIMIT 20""")
def trending(spark, d):
    log = query_log(spark, d)
    known = log.select(F.explode(F.split("query", " ")).alias("w")).where("w <> 'signup'")
    return suggest.trending(suggest.keyword_counts(log, known), 20)


@query("WITH " + DW + ", " + LOG + """, t AS (SELECT unnest(list_filter(string_split(query, ' '), lambda t: trim(t) <> '')) AS keyword FROM log)
 SELECT keyword, count(*) AS count FROM t WHERE keyword IN (SELECT w FROM dw) GROUP BY keyword""")
def keyword_count(spark, d):
    return suggest.keyword_counts(query_log(spark, d), index.lexicon(english_words(spark, d)))


WORDS = """asked AS (SELECT * FROM (VALUES (1, 'serach engine'), (2, 'vew'), (3, 'eror  clik'), (4, 'zzzzzzzz')) t(query_id, query)),
 popular AS (SELECT event_type AS keyword, count(*) AS count FROM events GROUP BY 1)"""
_ASKED = [(1, "serach engine"), (2, "vew"), (3, "eror  clik"), (4, "zzzzzzzz")]


def asked(spark):
    return spark.createDataFrame(_ASKED, "query_id int, query string")


def popular(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("keyword")).count()
    return suggest.trending(counts, 50)


@query("WITH " + WORDS + """, tok AS (SELECT query_id, query, unnest(list_filter(string_split(query, ' '), lambda t: trim(t) <> '')) AS token,
 generate_subscripts(list_filter(string_split(query, ' '), lambda t: trim(t) <> ''), 1) AS pos FROM asked),
 best AS (SELECT token, arg_min(keyword, (levenshtein(token, keyword), -count, keyword)) AS s FROM (SELECT DISTINCT token FROM tok), popular WHERE levenshtein(token, keyword) <= 2 GROUP BY token)
 SELECT query_id, query, CASE WHEN count(s) > 0 THEN string_agg(coalesce(s, token), ' ' ORDER BY pos) ELSE query END AS corrected FROM tok LEFT JOIN best USING (token) GROUP BY query_id, query""")
def spellcheck(spark, d):
    return suggest.corrected_queries(asked(spark), popular(spark, d), 2)


@query()
def spellcheck_compat(spark, d):
    """The same with the distance of the original service, which SQL can't say; tests hold it against golden values."""
    return suggest.corrected_queries(asked(spark), popular(spark, d), 2, compat=True)


CACHE = "cache AS (SELECT user_id AS doc_id, max(value) AS score, (epoch_us(max(ts)) // 1000)::bigint AS last_update FROM events GROUP BY user_id)"
NOW = 1706572800000


@query(f"WITH {CACHE} SELECT doc_id, score, last_update FROM cache WHERE {NOW} - last_update < 21600000")
def rank_cache_ttl(spark, d):
    ms = F.unix_millis(F.max("ts").cast("timestamp"))
    cache = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("value").alias("score"), ms.alias("last_update"))
    return suggest.fresh(cache, NOW, 21_600_000)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id::double / 2 WHEN doc_id % 3 = 1 THEN doc_id::double ELSE NULL END AS ranker_score FROM documents""")
def cached_ranks(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    cache = docs.where("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") / 2).alias("score"))
    ranks = docs.where("doc_id % 3 <> 2").select("doc_id", F.col("doc_id").cast("double").alias("rank"))
    return suggest.with_cached_ranks(docs, cache, ranks)


@query("""SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, max(value) AS max, round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.95), 8) AS p95
 FROM events GROUP BY event_type""")
def latency_metrics(spark, d):
    rows = suggest.latency(table(spark, d, "events"), ["event_type"])
    return rows.select("event_type", "n", F.round("mean", 8).alias("mean"), "max", F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"))


@query("""SELECT event_id, user_id, round(gap / 1e6, 6) AS gap_seconds FROM (SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap
 FROM events) WHERE gap > 30000000000""")
def worker_liveness(spark, d):
    """Heartbeats further apart than the limit (here 30 000 s, as events are sparse)."""
    gaps = crawl.access_gaps(table(spark, d, "events"), "user_id", 30_000)
    return gaps.where("gap_us > 30000000000").select("event_id", "user_id", F.round(F.col("gap_us") / 1e6, 6).alias("gap_seconds"))


GAPS = """SELECT event_id, user_id AS host, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events"""


@query(f"SELECT event_id, host, gap_us, coalesce(gap_us > 3600000000, true) AS ready FROM ({GAPS})")
def crawl_gap(spark, d):
    gaps = crawl.access_gaps(table(spark, d, "events"), "user_id", 3600)
    return gaps.select("event_id", F.col("user_id").alias("host"), "gap_us", "ready")


@query("""SELECT user_id::varchar AS host, count_if(event_type <> 'error') AS ok, count_if(event_type = 'error') AS failed FROM events GROUP BY 1""")
def host_counters(spark, d):
    events = table(spark, d, "events").withColumn("host", F.col("user_id").cast("string"))
    return crawl.outcomes(events, "host", F.col("event_type") == "error")


@query("""SELECT host, ok, failed, round(failed / nullif(ok + failed, 0), 8) AS share FROM (SELECT user_id::varchar AS host, count_if(event_type <> 'error') AS ok, count_if(event_type = 'error') AS failed
 FROM events GROUP BY 1) WHERE failed > 5 AND failed / nullif(ok + failed, 0) > 0.25""")
def bad_hosts(spark, d):
    return crawl.bad_hosts(host_counters(spark, d), 5, 0.25).withColumn("share", F.round("share", 8))


@query("""SELECT event_type AS outcome, count(*) AS n, round(count(*) / greatest(1, (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM events) / 1e6), 8) AS per_second FROM events GROUP BY 1""")
def outcome_counts(spark, d):
    events = table(spark, d, "events")
    us = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    span = events.agg(F.greatest(F.lit(1.0), (us(F.max) - us(F.min)) / 1e6).alias("span"))
    counts = events.groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(span)).select("outcome", "n", F.round(F.col("n") / F.col("span"), 8).alias("per_second"))


@query("""SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, to_json({'type': event_type, 'id': event_id})::varchar AS message FROM events""")
def queue_messages(spark, d):
    """Messages out as JSON and their fields in."""
    from seekwell.sources.io import to_messages

    out = F.struct(F.col("event_type").alias("type"), F.col("event_id").alias("id")).alias("m")
    events = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), out)
    sent = to_messages(events.select("m.*")).select(F.col("value").alias("message"), F.get_json_object("value", "$.id").cast("bigint").alias("event_id"))
    return events.select("event_id", "k").join(sent, "event_id")


@query("""SELECT name, coalesce(value, 0) AS value FROM (SELECT unnest(['spellcheck_top', 'none']) AS name) LEFT JOIN (SELECT 'spellcheck_top' AS name, 50 AS value) USING (name)""")
def config_values(spark, d):
    from seekwell.sources.io import config_value

    stored = spark.createDataFrame([("spellcheck_top", 50)], "name string, value int")
    one = lambda name: config_value(stored, name).select(F.lit(name).alias("name"), "value")
    return one("spellcheck_top").unionByName(one("none"))


@query("""SELECT user_id, keyword, sum(n)::bigint AS n FROM (SELECT user_id, event_type AS keyword, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2
 UNION ALL SELECT user_id, event_type, count(*) FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) GROUP BY 1, 2""")
def upsert_merge(spark, d):
    """Stored counts and a run of changes."""
    from seekwell.sources.io import upserted

    counts = lambda k: table(spark, d, "events").where(f"event_id % 2 = {k}").groupBy("user_id", F.col("event_type").alias("keyword")).agg(F.count("*").alias("n"))
    return upserted(counts(0), counts(1), ["user_id", "keyword"], "n")


@query("""SELECT user_id, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def first_seen(spark, d):
    """The first event of each user wins."""
    first = F.min(F.struct("ts", "event_id")).alias("f")
    return table(spark, d, "events").groupBy("user_id").agg(first).select("user_id", F.col("f.ts").alias("first_ts"), "f.event_id")


@query("""SELECT user_id, event_id AS last_event FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def last_access(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(order)).where("k = 1").select("user_id", F.col("event_id").alias("last_event"))


@query("""SELECT event_id, event_type FROM events JOIN (SELECT 'view' AS url, TIMESTAMP '2024-01-20' AS visited UNION ALL SELECT 'click', TIMESTAMP '2024-01-10') s ON url = event_type WHERE ts > visited
 UNION ALL SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')""")
def revisit(spark, d):
    """What is new, or has changed since it was seen."""
    seen = spark.sql("SELECT 'view' AS url, TIMESTAMP_NTZ '2024-01-20' AS visited UNION ALL SELECT 'click', TIMESTAMP_NTZ '2024-01-10'")
    current = table(spark, d, "events").select("event_id", F.col("event_type").alias("url"), F.col("ts").alias("modified"))
    return crawl.to_revisit(seen, current).select("event_id", F.col("url").alias("event_type"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS int) AS a, (event_id % 10)::int AS b FROM events""")
def id_list_parse(spark, d):
    """Lists of ids as text, such as [1, 2], read back."""
    text = F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(", "), (F.col("event_id") % 10).cast("string"), F.lit("]"))
    ids = F.from_json(text, "array<int>")
    return table(spark, d, "events").select("event_id", ids[0].alias("a"), ids[1].alias("b"))


@query("""SELECT event_id, date_trunc('second', ts) AS seen FROM events""")
def http_dates(spark, d):
    """Times written as HTTP dates and read back."""
    from seekwell.functions.text import http_date

    events = table(spark, d, "events")
    text = F.date_format(F.col("ts").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss z")
    return events.select("event_id", http_date(text).cast("timestamp_ntz").alias("seen"))


@query("""SELECT CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END AS url FROM (SELECT 'host' || user_id || '.org' AS url FROM events UNION ALL SELECT 'http://h' || user_id FROM events)""")
def seed_urls(spark, d):
    from seekwell.sources.io import seeds

    user = table(spark, d, "events").select("user_id")
    bare = user.select(F.concat(F.lit("host"), "user_id", F.lit(".org")).alias("url"))
    return seeds(bare.unionByName(user.select(F.concat(F.lit("http://h"), "user_id").alias("url"))))


@query(f"""WITH {DW} SELECT count(*) AS rows, count(DISTINCT w) AS words, count(DISTINCT doc_id) AS docs FROM dw""")
def store_statistics(spark, d):
    from seekwell.sources.io import stored_statistics

    return stored_statistics(english_words(spark, d))[0]


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS doc_id FROM events""")
def url_sync(spark, d):
    """Ids of links by URL; those of unknown URLs are -1."""
    from seekwell.sources.io import with_doc_ids

    url = F.concat(F.lit("http://h/"), F.col("user_id").cast("string"))
    events = table(spark, d, "events")
    known = events.where("user_id % 3 <> 0").select(url.alias("url"), F.col("user_id").alias("doc_id")).distinct()
    return with_doc_ids(events.select("event_id", url.alias("url")), known).select("event_id", "doc_id")


@query("""SELECT event_id FROM events WHERE event_type IN ('view', 'click')""")
def mime_filter(spark, d):
    """Answers that are HTML, whatever the case and parameters of their type."""
    kind = F.when(F.col("event_type") == "view", "text/html").when(F.col("event_type") == "click", " Text/HTML; charset=utf-8").otherwise("application/pdf")
    return table(spark, d, "events").withColumn("content_type", kind).where(crawl.is_html(F.col("content_type"))).select("event_id")


@query("""SELECT event_type, count(*) AS n, 1 AS tasks FROM events GROUP BY 1""")
def routed_rows(spark, d):
    """Rows dealt in turn, by their fields and to the first executor: all arrive, and those with equal fields in one task."""
    from seekwell.operators import dataflow

    events = table(spark, d, "events").select("event_id", "event_type")
    routed = dataflow.by_fields(dataflow.shuffle(events, 5), 3, "event_type").withColumn("task", F.spark_partition_id())
    return dataflow.to_first(routed.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("task").cast("int").alias("tasks")))
