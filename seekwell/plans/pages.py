"""Pages: extraction, hits, scores, URLs, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.functions import html as H
from seekwell.functions import url as U
from seekwell.operators import crawl, index, match, score
from seekwell.operators.ranking import page_of
from seekwell.plans.registry import query
from seekwell.session import table

ENGLISH = "html LIKE '%<html lang=\"en%'"
VIS = r"regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"


def plain(x: str) -> str:
    text = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in H.ENTITIES:
        text = f"replace({text}, '{entity.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


_H = "'(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>'"
_A = "'(?s)<a [^>]*href=\"([^\"]*)\"[^>]*>(.*?)</a>'"
_END = "'(?s)</p>.*|</article>.*|</div>.*|</section>.*|</body>.*'"
HEADINGS = f"""headings AS (SELECT page_id, idx, level, {plain('raw')} AS text FROM (SELECT page_id,
 (generate_subscripts(regexp_extract_all({VIS}, {_H}, 1), 1) - 1)::int AS idx, unnest(regexp_extract_all({VIS}, {_H}, 1)) AS level,
 unnest(regexp_extract_all({VIS}, {_H}, 2)) AS raw FROM pages))"""
PARAGRAPHS = f"""paras AS (SELECT page_id, idx, {plain(f"regexp_replace(raw, {_END}, '')")} AS text FROM (SELECT page_id,
 (generate_subscripts(l[2:], 1) - 1)::int AS idx, unnest(l[2:]) AS raw FROM (SELECT page_id, string_split_regex({VIS}, '<p(?: [^>]*)?>') AS l FROM pages)))"""
SHORT = "short AS (SELECT page_id, idx, text FROM paras WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY idx) <= 2)"
ANCHORS = f"""anch AS (SELECT page_id, url, idx, href, {plain('raw')} AS text FROM (SELECT page_id, url,
 (generate_subscripts(regexp_extract_all({VIS}, {_A}, 1), 1) - 1)::int AS idx, unnest(regexp_extract_all({VIS}, {_A}, 1)) AS href,
 unnest(regexp_extract_all({VIS}, {_A}, 2)) AS raw FROM pages))"""
LINES = f"""{HEADINGS}, {PARAGRAPHS}, {SHORT}, en AS (SELECT page_id FROM pages WHERE {ENGLISH}), lines AS (
 SELECT page_id AS doc_id, 'h' || level || idx AS tag, text FROM headings WHERE page_id IN (SELECT page_id FROM en)
 UNION ALL SELECT page_id, 'p' || idx, text FROM short WHERE page_id IN (SELECT page_id FROM en))"""
_T = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"
HITS = rf"""{LINES}, spans AS (SELECT doc_id, tag, text, (generate_subscripts(t, 1) - 1)::int AS pos, unnest(t) AS w, unnest(list_transform(t, lambda x, i:
 coalesce(list_sum(list_transform(t[1:i - 1], lambda y: length(y))), 0)::bigint + list_sum(list_transform(g[1:i], lambda y: length(y)))::bigint)) AS off
 FROM (SELECT doc_id, tag, text, regexp_extract_all(text, {_T}) AS t, string_split_regex(text, {_T}) AS g FROM lines)),
 hits AS (SELECT doc_id, lower(w) AS word, tag, pos, CASE WHEN regexp_matches(w, '^\p{{Lu}}') THEN 1 ELSE 0 END AS cap,
 CASE WHEN off > 50 THEN ' ...' ELSE '' END || substring(text, (greatest(off - 50, 0) + 1)::int, 200) ||
 CASE WHEN least(greatest(off - 50, 0) + 200, length(text)) <> length(text) THEN '... ' ELSE '' END AS context FROM spans)"""
WORDS = ["that", "for"]
FOUND = f"""{HITS}, found AS (SELECT * FROM hits WHERE word IN ('that', 'for')
 AND doc_id IN (SELECT doc_id FROM hits WHERE word IN ('that', 'for') GROUP BY doc_id HAVING count(DISTINCT word) = 2))"""
W = "CASE left(tag, 1) WHEN 'h' THEN 1.3::double WHEN 'a' THEN 1.2::double ELSE 1.0::double END"
TAG = f"tags AS (SELECT doc_id, sum({W}) / count(*) AS tag_score FROM found GROUP BY doc_id)"
PROX = f"""prox AS (SELECT doc_id, avg(w * CASE WHEN n = 2 THEN 1.5::double WHEN n >= 2 THEN 1.2::double ELSE 1.0::double END) AS proximity_score
 FROM (SELECT doc_id, tag, any_value({W}) AS w, count(*) AS n FROM found GROUP BY doc_id, tag) GROUP BY doc_id)"""
BEST = """best AS (SELECT doc_id, tag, context FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tag) AS n,
 CASE WHEN tag LIKE 'p%' THEN 0 WHEN tag LIKE 'h1%' THEN 2 WHEN tag LIKE 'h%' THEN 1 END AS r FROM found)
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r, n DESC, tag, pos, word) = 1)"""


def english(spark, d):
    pages = table(spark, d, "pages")
    return pages.where(crawl.english_page(F.col("html")))


def english_hits(spark, d):
    pages = english(spark, d)
    return index.word_hits(index.heading_lines(pages).unionByName(index.paragraph_lines(pages)))


def found_hits(spark, d):
    """Hits of the query's words in pages that hold all of them."""
    hits = english_hits(spark, d).where(F.col("word").isin(WORDS))
    full = hits.groupBy("doc_id").agg(F.count_distinct("word").alias("n")).where(F.col("n") == len(WORDS))
    return hits.join(full, "doc_id", "left_semi")


@query(f"SELECT page_id, substring({plain(chr(39).join(['regexp_extract(html, ', '(?s)<title[^>]*>(.*?)</title>', ', 1)']))}, 1, 150) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", H.title(F.col("html")).alias("title"))


@query(f"WITH {PARAGRAPHS} SELECT page_id, coalesce((SELECT substring(min_by(text, idx), 1, 250) FROM paras WHERE paras.page_id = pages.page_id AND text <> ''), '') AS summary FROM pages")
def page_summary(spark, d):
    return table(spark, d, "pages").select("page_id", H.summary(F.col("html")).alias("summary"))


@query(f"WITH {HEADINGS} SELECT page_id AS doc_id, 'h' AS kind, idx, 'h' || level || idx AS tag, text FROM headings")
def page_headings(spark, d):
    return index.heading_lines(table(spark, d, "pages"))


@query(f"WITH {PARAGRAPHS}, {SHORT} SELECT page_id AS doc_id, 'p' AS kind, idx, 'p' || idx AS tag, text FROM short")
def page_paragraphs_short(spark, d):
    return index.paragraph_lines(table(spark, d, "pages"))


@query(f"WITH {PARAGRAPHS} SELECT page_id AS doc_id, 'p' AS kind, idx, 'p' || idx AS tag, text FROM paras")
def page_paragraphs_full(spark, d):
    return index.paragraph_lines(table(spark, d, "pages"), None)


NORM = r"""CASE WHEN regexp_matches({0}, '^https?://[^/?#:]+') THEN regexp_extract({0}, '^(https?)://', 1) || '://' || regexp_extract({0}, '^https?://([^/?#:]*)', 1) || ':' ||
 CASE WHEN regexp_extract({0}, '^https?://[^/?#:]*:([0-9]{{1,5}})(?:[/?#]|$)', 1) <> '' THEN regexp_extract({0}, '^https?://[^/?#:]*:([0-9]{{1,5}})', 1)
 WHEN {0} LIKE 'https:%' THEN '443' ELSE '80' END || regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1) || regexp_extract({0}, '^https?://[^?#]*(\?[^#]*)', 1) END"""
ROOT = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query(f"WITH {ANCHORS} SELECT page_id AS from_id, idx, href, text, {NORM.format('link')} AS url FROM (SELECT *, CASE WHEN href LIKE '/%' THEN {ROOT} || href ELSE href END AS link FROM anch)")
def page_anchors(spark, d):
    return index.anchors(table(spark, d, "pages"))


def known_targets(spark, d):
    """Link targets as pages: each distinct URL that some page links to, numbered in order; it makes links resolve."""
    links = index.anchors(table(spark, d, "pages"))
    return links, crawl.with_ids(links)


@query(f"""WITH {ANCHORS}, links AS (SELECT page_id, idx, text, {NORM.format('link')} AS target FROM (SELECT *, CASE WHEN href LIKE '/%' THEN {ROOT} || href ELSE href END AS link FROM anch)),
 ids AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS doc_id FROM (SELECT DISTINCT target FROM links WHERE target IS NOT NULL))
 SELECT doc_id, 'a' AS kind, idx, 'a_' || page_id || '_' || idx AS tag, text FROM links JOIN ids USING (target)""")
def anchor_lines(spark, d):
    links, urls = known_targets(spark, d)
    return index.anchor_lines(links, urls)


@query(f"SELECT page_id, {plain(f'''regexp_replace({VIS}, '<[^>]*>', ' ', 'g')''')} AS text FROM pages")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", H.page_text(F.col("html")).alias("text"))


@query(f"WITH {HITS} SELECT doc_id, word, tag, pos, cap FROM hits")
def word_hits(spark, d):
    return english_hits(spark, d).select("doc_id", "word", "tag", "pos", "cap")


@query(f"WITH {HITS} SELECT doc_id, word, tag, pos, context FROM hits")
def hit_context(spark, d):
    return english_hits(spark, d).select("doc_id", "word", "tag", "pos", "context")


@query(f"WITH {HITS} SELECT word, doc_id, count(*) AS n, string_agg(tag || ':' || pos, ',' ORDER BY tag, pos) AS places FROM hits GROUP BY word, doc_id")
def postings(spark, d):
    lists = index.postings(english_hits(spark, d))
    return lists.select("word", "doc_id", F.size("hits").cast("bigint").alias("n"), F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["tag"], h["pos"])), ",").alias("places"))


@query(f"WITH {FOUND}, {TAG} SELECT doc_id, round(tag_score, 8) AS tag_score FROM tags")
def tag_score(spark, d):
    return score.tag_scores(found_hits(spark, d)).select("doc_id", F.round("tag_score", 8).alias("tag_score"))


@query(f"WITH {FOUND}, {PROX} SELECT doc_id, round(proximity_score, 8) AS proximity_score FROM prox")
def proximity_score(spark, d):
    return score.proximity_scores(found_hits(spark, d), 2).select("doc_id", F.round("proximity_score", 8).alias("proximity_score"))


@query(f"WITH {FOUND} SELECT doc_id, left(tag, 1) AS kind, tag, count(*) AS n FROM found GROUP BY doc_id, tag")
def tag_counts(spark, d):
    return found_hits(spark, d).groupBy("doc_id", F.substring("tag", 1, 1).alias("kind"), "tag").agg(F.count("*").alias("n"))


@query(f"WITH {FOUND}, {BEST} SELECT doc_id, tag, context FROM best")
def context_pick(spark, d):
    return score.best_contexts(found_hits(spark, d))


@query(f"WITH {FOUND}, {BEST} SELECT doc_id, replace(replace(context, 'that', '<b>that</b>'), 'for', '<b>for</b>') || ' ... ' AS display FROM best")
def context_highlight(spark, d):
    best = score.best_contexts(found_hits(spark, d))
    return best.select("doc_id", score.highlighted(F.col("context"), WORDS).alias("display"))


WEIGHTS = [("tagScore", 2.0, False), ("proximityScore", 1.5, True), ("rankerScore", 0.5, False)]
TOTAL = f"""{FOUND}, {TAG}, {PROX}, total AS (SELECT doc_id, round(2.0::double * tag_score + 1.5::double * ln(proximity_score), 8) AS total_score FROM tags JOIN prox USING (doc_id))"""


def totals(spark, d):
    hits = found_hits(spark, d)
    both = score.tag_scores(hits).join(score.proximity_scores(hits, 2), "doc_id")
    features = both.select("doc_id", F.create_map(F.lit("tagScore"), "tag_score", F.lit("proximityScore"), "proximity_score").alias("features"))
    weights = spark.createDataFrame(WEIGHTS, "name string, coeff double, use_log boolean")
    return score.total_scores(features, weights).withColumn("total_score", F.round("total_score", 8))


@query(f"WITH {TOTAL} SELECT doc_id, total_score FROM total")
def total_score(spark, d):
    return totals(spark, d)


@query(f"WITH {TOTAL} SELECT doc_id, total_score FROM total ORDER BY total_score DESC, doc_id LIMIT 100")
def ranked_search(spark, d):
    return score.ranked(totals(spark, d))


@query(f"WITH {TOTAL} SELECT doc_id, total_score, row_number() OVER (ORDER BY total_score DESC, doc_id)::int AS position FROM total QUALIFY position BETWEEN 11 AND 20")
def result_page(spark, d):
    return page_of(totals(spark, d), 2, [F.desc("total_score"), F.asc("doc_id")])


@query(f"WITH {TOTAL} SELECT doc_id, to_json({{'docId': doc_id, 'totalScore': total_score}})::varchar AS json FROM total")
def json_result(spark, d):
    rows = totals(spark, d).select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("docId"), F.col("total_score").alias("totalScore"))).alias("json"))
    return rows


@query(rf"""SELECT page_id, url LIKE 'https:%' AS secure, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port,
 regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^https?://[^?#]*(\?[^#]*)', 1) AS query, regexp_extract(url, '(#.*)$', 1) AS anchor FROM pages""")
def url_parts(spark, d):
    rows = table(spark, d, "pages").select("page_id", U.url_parts(F.col("url")).alias("u"))
    return rows.select("page_id", *[f"u.{c}" for c in ("secure", "host", "port", "path", "query", "anchor")])


@query(f"SELECT page_id, {NORM.format('url')} AS url_norm FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("url_norm"))


_HASH = """list_reduce(list_prepend(0::bigint, list_transform(string_split(host, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296)"""


@query(f"""SELECT page_id, (abs(h - CASE WHEN h >= 2147483648 THEN 4294967296 ELSE 0 END) % 5)::int AS worker
 FROM (SELECT page_id, {_HASH} AS h FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host FROM pages))""")
def url_worker(spark, d):
    return table(spark, d, "pages").select("page_id", U.worker_of(F.col("url"), 5).alias("worker"))


LANG = "regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id, starts_with({LANG}, 'en') AS for_index, {LANG} = '' OR starts_with(lower({LANG}), 'en') AS for_crawl FROM pages")
def english_filter(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", crawl.english_page(html).alias("for_index"), crawl.english_page(html, False).alias("for_crawl"))


@query("""SELECT doc_id, (contains(lower(text), 'antion')::int + contains(lower(text), 'retion')::int + contains(lower(text), 'edtion')::int) AS found FROM documents
 WHERE contains(lower(text), 'antion')::int + contains(lower(text), 'retion')::int + contains(lower(text), 'edtion')::int >= 2""")
def keyword_relevance(spark, d):
    keywords = ["antion", "Retion", "edtion"]
    docs = table(spark, d, "documents")
    return docs.where(crawl.relevant(F.col("text"), keywords, 2)).select("doc_id", crawl.relevance(F.col("text"), keywords).alias("found"))


@query("SELECT page_id, length(html) AS chars FROM pages WHERE length(html) <= 3000")
def size_filter(spark, d):
    return table(spark, d, "pages").where(crawl.within_size(F.col("html"), 3000)).select("page_id", F.length("html").cast("bigint").alias("chars"))


@query(f"SELECT {NORM.format('url')} AS url_norm, min(page_id) AS page_id FROM pages GROUP BY 1")
def url_dedup(spark, d):
    return crawl.first_by_url(table(spark, d, "pages")).select("url_norm", "page_id")


@query("SELECT regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1")
def host_stats(spark, d):
    return crawl.pages_per_host(table(spark, d, "pages"))


@query(f"""WITH {ANCHORS}, n AS (SELECT page_id, count(*) AS links, count(DISTINCT href) AS hrefs FROM anch GROUP BY page_id)
 SELECT count(*) AS pages, min(links) AS least, max(links) AS most, round(avg(links), 8) AS mean, max(hrefs) AS most_different FROM n""")
def out_degree_stats(spark, d):
    n = index.anchors(table(spark, d, "pages")).groupBy("from_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("hrefs"))
    return n.agg(F.count("*").alias("pages"), F.min("links").alias("least"), F.max("links").alias("most"), F.round(F.avg("links"), 8).alias("mean"), F.max("hrefs").alias("most_different"))


@query(f"""WITH {ANCHORS}, links AS (SELECT page_id AS from_id, {NORM.format('link')} AS url, min(idx) AS idx FROM (SELECT *, CASE WHEN href LIKE '/%' THEN {ROOT} || href ELSE href END AS link FROM anch) GROUP BY 1, 2)
 SELECT from_id, url, idx FROM links WHERE url NOT IN (SELECT {NORM.format('url')} FROM pages) QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY idx) <= 4""")
def emit_cap(spark, d):
    pages = table(spark, d, "pages")
    return crawl.emitted(index.anchors(pages), index.url_ids(pages), 3)


@query(f"SELECT url, row_number() OVER (ORDER BY url) - 1 AS doc_id FROM (SELECT DISTINCT {NORM.format('url')} AS url FROM pages)")
def doc_id_assign(spark, d):
    return crawl.with_ids(table(spark, d, "pages").select(U.normalize(F.col("url")).alias("url")))


@query(f"SELECT row_number() OVER (ORDER BY url) - 1 || chr(9) || url AS value FROM (SELECT DISTINCT {NORM.format('url')} AS url FROM pages)")
def id_url_listing(spark, d):
    from seekwell.sources.io import id_url_listing

    return id_url_listing(crawl.with_ids(table(spark, d, "pages").select(U.normalize(F.col("url")).alias("url"))))


@query(f"SELECT page_id FROM pages WHERE length(html) <= {crawl.PUBLISHED_CHARS}")
def publishable_pages(spark, d):
    return crawl.publishable(table(spark, d, "pages")).select("page_id")


@query()
def page_lines_udtf(spark, d):
    """The table function for irregular pages; no SQL can say it."""
    spark.udtf.register("page_lines", H.PageLinesTable)
    table(spark, d, "pages").createOrReplaceTempView("seekwell_pages")
    return spark.sql("SELECT page_id, t.tag, t.idx, t.text FROM seekwell_pages, LATERAL page_lines(html) t")


@query(f"""WITH {FOUND}, {TAG}, {PROX}, tf AS (SELECT doc_id, word, count(*)::double AS tf FROM hits GROUP BY doc_id, word),
 weights AS (SELECT doc_id, word, sqrt(tf * tf / sum(tf * tf) OVER (PARTITION BY doc_id)) AS ntf FROM tf),
 lex AS (SELECT word, ln((SELECT count(DISTINCT doc_id) FROM tf)::double / count(*)) AS idf FROM tf GROUP BY word),
 m AS (SELECT doc_id, round(sum(ntf * idf), 8) AS s FROM weights JOIN lex USING (word) WHERE word IN ('that', 'for') GROUP BY doc_id HAVING count(*) = 2)
 SELECT doc_id, url, title, round(3.0::double * s + 2.0::double * tag_score + 1.5::double * ln(proximity_score) + 0.5::double * (1.0::double / (1 + doc_id)), 8) AS total_score
 FROM m JOIN tags USING (doc_id) JOIN prox USING (doc_id) JOIN (SELECT page_id AS doc_id, url, substring({plain("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")}, 1, 150) AS title FROM pages) USING (doc_id)
 ORDER BY total_score DESC, doc_id LIMIT 20""")
def full_search(spark, d):
    """A query from match to ranked results: term weights, tags, proximity and a link score, weighted and joined with
    what is shown of each page."""
    hits = english_hits(spark, d)
    words = hits.groupBy("doc_id", F.col("word").alias("w")).agg(F.count("*").alias("tf"))
    found = match.matches(words, WORDS, None)  # any match may be among the best when all scores are added
    own = hits.where(F.col("word").isin(WORDS)).join(found.select("doc_id"), "doc_id", "left_semi")
    rank = (F.lit(1.0) / (F.col("doc_id") + 1)).alias("rank")
    both = found.join(score.tag_scores(own), "doc_id").join(score.proximity_scores(own, 2), "doc_id").select("*", rank)
    features = both.select(
        "doc_id",
        F.create_map(F.lit("tfIdf"), "score", F.lit("tagScore"), "tag_score", F.lit("proximityScore"), "proximity_score", F.lit("rankerScore"), "rank").alias("features"),
    )
    weights = spark.createDataFrame([("tfIdf", 3.0, False), *WEIGHTS], "name string, coeff double, use_log boolean")
    totals = score.total_scores(features, weights).withColumn("total_score", F.round("total_score", 8))
    shown = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url", H.title(F.col("html")).alias("title"))
    return shown.join(F.broadcast(score.ranked(totals, 20)), "doc_id")


@query(r"""SELECT page_id, regexp_matches(regexp_extract(url, '^https?://([^/?#:]*)', 1), '[#?:]') OR regexp_extract(url, '^https?://([^/?#:]*)', 1) = '' AS suspect FROM pages""")
def host_flags(spark, d):
    """A data-quality flag: hosts that still hold separators, or none."""
    return table(spark, d, "pages").select("page_id", U.host_is_suspect(F.col("url")).alias("suspect"))
