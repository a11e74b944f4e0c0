"""Quality rules: distribution divergence from language references, after the counting rules that every text must pass.

Histograms of character classes and of common words are compared with those of the text's language by Jensen-Shannon
distance. The references are sums over all texts of a language, as the corpus names it, that pass the counting rules;
only languages with a list of common words have the second histogram. Texts shorter than a guard are not judged by distance, as their histograms are mostly noise. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.functions.barrier import once
from seekwell.session import materialize

#: Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
#: What separates words, and what counts as a symbol.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOL_RUN = r"[#*$%&|<>]+"
#: Counting rules: fewer words than this fail, and texts whose repeated windows cover more than this share.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: Guards: with fewer words (for the words' histogram) or characters (for the classes') a text isn't judged by distance.
WORDS_GUARD, CHARS_GUARD = 100, 300
#: Distances (0 to 1) beyond which a text fails.
MOST_CHAR_DISTANCE, MOST_WORD_DISTANCE = 0.32, 0.235
HELD = "__quality"


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def repeated_positions(windows: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more; `windows` is a sorted array of (h, i).

    Windows take three words: one that begins d words after the last repeated one adds min(3, d) words.
    """
    same = lambda x, k: F.get(windows, k)["h"] == x["h"]
    repeated = F.filter(windows, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
    starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
    step = lambda at, n: F.struct(at.cast("int").alias("at"), n.cast("bigint").alias("n"))
    return F.aggregate(starts, step(F.lit(-9), F.lit(0)), lambda s, i: step(i, s["n"] + F.least(F.lit(3), i - s["at"])), lambda s: s["n"])


def measure(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """`docs` with one more column, a struct of counts: everything about a text that the rules use."""
    own = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = once(docs, "__w", words_of(text))
    w = F.col("__w")
    triples = F.zip_with(
        F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(w, 3, 1 << 30),
        lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab["a"], ab["b"], c)),
    )
    windows = F.transform(F.slice(triples, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    every = sorted({c for words in COMMON_WORDS.values() for c in words})
    df = once(df, "__s", F.array_sort(windows))
    df = once(df, "__l", lines)
    df = once(df, "__c", F.filter(F.transform(w, F.lower), lambda x: x.isin(every)))
    # Classes are stripped one after another, the largest first, so later passes see short rests.
    df = once(df, "__1", F.regexp_replace(text, "[a-z]+", ""))
    df = once(df, "__2", F.regexp_replace("__1", SPACE_RUN, ""))
    df = once(df, "__3", F.regexp_replace("__2", "[A-Z]+", ""))
    df = once(df, "__4", F.regexp_replace("__3", "[0-9]+", ""))
    df = once(df, "__5", F.regexp_replace("__4", SYMBOL_RUN, ""))
    df = once(df, "__6", F.regexp_replace("__5", r"[\x00-\x7F]+", ""))
    length = [F.length(text), *[F.length(f"__{i}") for i in range(1, 7)]]
    classes = F.array(*[(a - b).cast("bigint") for a, b in zip(length, length[1:])], length[-1].cast("bigint"))
    df = once(df, "__r", F.col(f"`{lang_col}`").cast("string") if lang_col in own else F.lit(None).cast("string"))
    lists = F.create_map(*[x for name, words in COMMON_WORDS.items() for x in (F.lit(name), F.array(*map(F.lit, words)))])
    unlisted = F.array(*[F.lit("") for _ in next(iter(COMMON_WORDS.values()))])  # no word is empty
    listed = F.coalesce(F.element_at(lists, F.coalesce("__r", F.lit(""))), unlisted)
    counted = F.transform(listed, lambda c: F.size(F.filter("__c", lambda x: x == c)).cast("bigint"))
    df = once(df, "__k", counted)
    rest = F.size(w).cast("bigint") - F.aggregate("__k", F.lit(0).cast("bigint"), lambda a, x: a + x)
    n_words = F.size(w).cast("bigint")
    n_repeat = repeated_positions(F.col("__s"))
    df = once(df, "__n", n_repeat)
    counts = F.struct(
        n_words.alias("n_words"),
        (length[0] - (length[1] - length[2])).cast("bigint").alias("word_chars"),
        (length[4] - length[5]).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.col("__n").alias("n_repeat_words"),
        ((n_words < LEAST_WORDS) | (F.col("__n") * 100 > n_words * MOST_REPEATED_PERCENT)).alias("base_failed"),
        length[0].cast("bigint").alias("n_chars"),
        F.col("__r").alias("reference"),
        classes.alias("classes"),
        F.concat("__k", F.array(rest)).alias("words"),
    )
    return df.select(*[F.col(f"`{c}`") for c in own], counts.alias(HELD))


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts, 0 to 1; null if either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    share = lambda h: F.transform(h, lambda x: x / F.nullif(total(h), F.lit(0.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share(own), share(reference), lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judge(measured: DataFrame) -> DataFrame:
    """Measured rows with char_distance, word_distance (null where a guard holds) and kept. `measured` is read twice:
    for the references, a row per language, and for the verdicts."""
    held = F.col(HELD)
    summed = lambda field, n: F.array(*[F.sum(held[field][i]).cast("double") for i in range(n)])
    n_words = len(next(iter(COMMON_WORDS.values()))) + 1
    references = (  # a row per language; the planner broadcasts them if they are few
        measured.where(~held["base_failed"] & held["reference"].isNotNull())
        .groupBy(held["reference"].alias("__r"))
        .agg(summed("classes", 7).alias("__classes"), summed("words", n_words).alias("__words"))
    )
    as_double = lambda h: F.transform(h, lambda x: x.cast("double"))
    df = measured.join(materialize(references), held["reference"] == F.col("__r"), "left")
    listed = held["reference"].isin(list(COMMON_WORDS))
    df = df.withColumns(
        {
            "char_distance": F.when(held["n_chars"] >= CHARS_GUARD, distance(as_double(held["classes"]), F.col("__classes"))),
            "word_distance": F.when(listed & (held["n_words"] >= WORDS_GUARD), distance(as_double(held["words"]), F.col("__words"))),
        }
    )
    far = (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return df.withColumn("kept", ~held["base_failed"] & ~far)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, the counts, base_failed, both distances and kept.

    A null or empty text has no words and fails. A row without a language is judged by the counting rules alone, one
    whose language has no list of common words also by its character classes; neither adds to another language's
    reference. Repeated rows and null ids stay rows of their own, an empty table gives no rows, and of other columns
    only `lang` is read, so their names can't clash. The text is dropped before anything is written; the only shuffles
    are of a few sums per language.
    """
    named = ["lang"] if "lang" in docs.columns else []
    read = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), *named)
    judged = judge(materialize(measure(read).select("__id", HELD)))
    counts = [F.col(HELD)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return judged.select(F.col("__id").alias(id_col), *counts, "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that pass all rules, columns unchanged whatever their names; repeated rows are judged alike and
    an empty table stays empty. The rows are written once beside their counts."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    named = [F.col(f"`{lang_col}`").alias("lang")] if lang_col in docs.columns else []
    measured = measure(docs.select(row, F.col(f"`{text_col}`").alias("text"), *named)).select("__row", HELD)
    return judge(materialize(measured)).where("kept").select("__row.*")
