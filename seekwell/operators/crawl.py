"""Crawl-side data work: page filters, deduplication, host statistics, link emission, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.functions import html as H
from seekwell.functions import text as X
from seekwell.functions import url as U
from seekwell.operators.ranking import first_per, global_rank

MOST_BYTES, PUBLISHED_CHARS = 390 * 1024, 385 * 1024


def english_page(html: Column, strict: bool = True) -> Column:
    """For the index, lang must start with `en`; for the crawl, in any case, and pages that don't say are taken."""
    lang = H.language(html)
    return lang.startswith("en") if strict else (lang == "") | F.lower(lang).startswith("en")


def relevance(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords the text holds, in any case."""
    found = [F.when(X.contains_any_case(text, F.lit(k)), 1).otherwise(0) for k in sorted(set(keywords))]
    return sum(found[1:], found[0]) if found else F.lit(0)


def relevant(text: Column, keywords: list[str], threshold: int, least: float = 0.0, seed: int | None = None) -> Column:
    """Texts with `threshold` keywords pass. With a seed, others pass with a probability of found / threshold plus
    `least`; without one they don't."""
    n = relevance(text, keywords)
    if seed is None:
        return n >= threshold
    return F.rand(seed) >= 1 - (F.least(n, F.lit(threshold)) / F.lit(threshold) + F.lit(least))


def within_size(content: Column, most: int = MOST_BYTES) -> Column:
    return F.length(content) <= most


def is_html(content_type: Column) -> Column:
    return F.lower(F.trim(content_type)).startswith("text/html")


def first_by_url(pages: DataFrame) -> DataFrame:
    """One page for each normal form of its URL, the least id; pages whose URL can't be read go."""
    rows = pages.withColumn("url_norm", U.normalize(F.col("url"))).where("url_norm IS NOT NULL")
    least = rows.groupBy("url_norm").agg(F.min("page_id").alias("page_id"))
    return rows.join(least, ["url_norm", "page_id"], "left_semi")


def content_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(content_hash, first id, copies) of texts that are equal but for white space."""
    return docs.groupBy(X.content_hash(F.col(text_col)).alias("content_hash")).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def outcomes(events: DataFrame, host_col: str, failed: Column) -> DataFrame:
    """(host, ok, failed) counters."""
    return events.groupBy(F.col(host_col).alias("host")).agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))


def bad_hosts(counters: DataFrame, min_fails: int, ratio: float) -> DataFrame:
    """Hosts with more than `min_fails` failures that are more than `ratio` of all tries."""
    share = F.col("failed") / F.nullif(F.col("ok") + F.col("failed"), F.lit(0))
    return counters.withColumn("share", share).where((F.col("failed") > min_fails) & (F.col("share") > ratio))


def access_gaps(events: DataFrame, host_col: str, delay_seconds: float) -> DataFrame:
    """Each access with the microseconds since the host's last one, and whether the delay had passed by then."""
    order = Window.partitionBy(host_col).orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    return events.withColumn("gap_us", gap).withColumn("ready", F.coalesce(F.col("gap_us") > int(delay_seconds * 1e6), F.lit(True)))


def emitted(links: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """Links (from_id, idx, url) to send on: not seen before, once per page, at most `most` + 1 of each page in order
    (the count is checked after sending); 0 or less means all."""
    new = links.where("url IS NOT NULL").join(seen.select("url").distinct(), "url", "left_anti")
    once = new.groupBy("from_id", "url").agg(F.min("idx").alias("idx"))
    return once if most <= 0 else first_per(once, ["from_id"], [F.asc("idx")], most + 1)


def pages_per_host(pages: DataFrame) -> DataFrame:
    return pages.groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


def with_ids(urls: DataFrame) -> DataFrame:
    """(url, doc_id): dense ids in the order of the URLs."""
    return global_rank(urls.select("url").where("url IS NOT NULL").distinct(), ["url"], "doc_id")


def publishable(pages: DataFrame) -> DataFrame:
    """Pages short enough to publish."""
    return pages.where(within_size(F.col("html"), PUBLISHED_CHARS))


def to_revisit(seen: DataFrame, current: DataFrame) -> DataFrame:
    """URLs of `current` (url, modified) that are new, or changed since `seen` (url, visited)."""
    joined = current.join(seen, "url", "left")
    return joined.where(F.col("visited").isNull() | (F.col("modified") > F.col("visited")))
