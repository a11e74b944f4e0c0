"""Small tables with everything that goes wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest

CLASHING = "id long, n long, sig string, key long, component string, kept string, shard string, slot long, uid long, spans string, n_tokens string, pieces string, filling string, score string, rank string, n_entities string, char_distance string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
N = len(CLASHING.split(","))

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near the old stone bridge and sing".split()


def long_text(n, step=7):
    return " ".join(WORDS[(i * step + i // 11) % len(WORDS)] + (str(i % 97) if i % 5 == 0 else "") for i in range(n))


ROWS = [
    (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \n\t ", None, "s1"), (4, "one", "en", None), (5, "one", "de", "s1"), (6, "ONE two", None, "s1"),
    (7, long_text(400), "en", "s0"), (8, long_text(400), "en", "s2"), (9, long_text(400) + " extra words", "en", "s0"), (10, long_text(60_000), "en", "s0"),
    (11, "x" * 200_000, "xx", "s0"), (12, "12 !! ?? 34", "en", "s0"), (13, "é ü ß 中文 😀   \x85 end", "fr", "s3"), (None, "no id here", "en", "s0"),
    (14, "same row", "en", "s0"), (14, "same row", "en", "s0"), (15, "<|endoftext|> token = \"abcdef0123456789abcdef\" <s>", "en", "s0"), (16, long_text(2_000, 3), "de", "s0"),
]


def table(spark, rows):
    filler = (7, 7, "c", 7, "c", "c", "c", 7, 7, "c", "c", "c", "c", "c", "c", "c", "c")
    assert len(filler) == N
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), *filler) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    return table(spark, ROWS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])
