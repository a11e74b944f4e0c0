"""Text functions as column expressions: tokens with places, contexts, case variants, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekwell.functions.arrays import running_starts

#: Words of letters and digits; punctuation marks are tokens of their own.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Lower-case ASCII words, as the index of plain documents uses.
WORD = "[a-z0-9]+"
CONTEXT_BEFORE, CONTEXT_LENGTH = 50, 200


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_spans(text: Column, pattern: str = TOKEN) -> Column:
    """array<struct<w, at>>: each token and the number of characters before it. Gaps and tokens alternate, so places
    are running sums of their lengths."""
    words = tokens(text, pattern)
    lengths = F.zip_with(F.split(text, pattern, -1), words, lambda g, w: (F.length(g) + F.coalesce(F.length(w), F.lit(0))).cast("bigint"))
    ends = F.slice(running_starts(lengths), 2, 1 << 30)  # where each token ends: the start of the gap after it
    return F.zip_with(words, ends, lambda w, end: F.struct(w.alias("w"), (end - F.length(w)).cast("int").alias("at")))


def context(line: Column, at: Column) -> Column:
    """The 200 characters around a token, from 50 before it, with marks where the line goes on."""
    begin = F.greatest(at - CONTEXT_BEFORE, F.lit(0))
    end = F.least(begin + CONTEXT_LENGTH, F.length(line))
    return F.concat(
        F.when(begin != 0, F.lit(" ...")).otherwise(""),
        F.substring(line, begin + 1, end - begin),
        F.when(end != F.length(line), F.lit("... ")).otherwise(""),
    )


def is_capitalized(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{Lu}"), 1).otherwise(0)


def case_variants(word: Column) -> Column:
    """The word, with an upper-case first letter, in lower case and in upper case, each once."""
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))
    return F.array_distinct(F.array(word, capital, F.lower(word), F.upper(word)))


def java_hash(text: Column) -> Column:
    """The 32-bit signed hash 31 * h + c over UTF-16 units, as a long."""
    units = F.flatten(
        F.transform(
            F.filter(F.split(text, ""), lambda c: c != ""),
            lambda c: F.when(
                F.ascii(c) > 0xFFFF,
                F.array(F.floor((F.ascii(c) - 0x10000) / 1024) + 0xD800, F.pmod(F.ascii(c) - 0x10000, F.lit(1024)).cast("bigint") + 0xDC00),
            ).otherwise(F.array(F.ascii(c).cast("bigint"))),
        )
    )
    unsigned = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(unsigned >= 1 << 31, unsigned - (1 << 32)).otherwise(unsigned)


def jvm_hash(text: Column) -> Column:
    """`java_hash` as Java computes it, as an int: for columns of many words. The optimiser takes it for no function of its
    input, so it can't stand in joins or be pushed below them."""
    return F.when(text.isNotNull(), F.reflect(F.lit("java.util.Objects"), F.lit("hashCode"), text).cast("int"))


def shard_of(word: Column, shards: int) -> Column:
    """The shard of a word's hits."""
    return F.pmod(java_hash(word), F.lit(shards)).cast("int")


def shard_number(word: str, shards: int) -> int:
    """`shard_of` of one word, for choosing which shards to read."""
    units = word.encode("utf-16-be", "surrogatepass")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) % (1 << 32)
    return (h - (1 << 32) if h >= 1 << 31 else h) % shards


def content_hash(text: Column) -> Column:
    """MD5 of the text without white space; equal pages have equal hashes whatever their layout."""
    return F.md5(F.regexp_replace(text, r"\s", ""))


def contains_any_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def safe_ln(x: Column) -> Column:
    """Natural logarithm, minus infinity at zero."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def password_digest(text: Column) -> Column:
    return F.upper(F.sha2(F.encode(text, "UTF-8"), 256))


def query_tokens(query: Column) -> Column:
    """A query's parts between spaces, blanks dropped."""
    return F.filter(F.split(query, " "), lambda t: F.trim(t) != "")


def http_date(text: Column) -> Column:
    """Timestamps such as `Wed, 21 Oct 2015 07:28:00 GMT` (the day's name says nothing new)."""
    return F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
