"""Packing by cutting-stock column generation.

Documents become pieces of at most `capacity` tokens: whole ones, and full cuts of longer ones. A linear program over
the histogram of their lengths chooses patterns of pieces that fill sequences; new patterns are priced by a knapsack
dynamic program until none improves the program. Patterns are rounded down, what remains is packed first-fit, and the
ranked pieces of each length class take the places of the patterns in order. A fixed share of the documents, chosen
by hash, is kept as filling: laid end to end and cut where the gaps of the sequences end, so almost nothing is padded.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekwell.llm.batches import by_bytes, ids_and_texts, small_batches, trim
from seekwell.session import materialize

#: Lengths are planned in classes of this many tokens, sequences in steps of that many.
UNIT, STEP = 32, 8
#: A length that one in so many pieces has is a class of its own.
FREQUENT = 100
#: One document in so many is filling.
FILLING = 16
#: Words that each Python worker keeps the ids of; beyond this the older half goes.
WORDS_KEPT, LONGEST_KEPT = 600_000, 64
#: How the vocabulary cuts lower-case text into words, for any text and for ASCII.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+").findall
#: The same for texts of ASCII and the small letters of Latin-1 only.
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9\xdf-\xf6\xf8-\xff]+").findall
BEYOND_LATIN = re.compile(r"[^\x00-\x7f\xdf-\xf6\xf8-\xff]").search
#: Fixed value: what tokens that end a word end with.
WORD_END = "</w>"
WORDS_AT_ONCE = 500
#: Pieces ranked, or intervals summed, by one task at a time.
RANKED_ROWS = 10_000
#: Tokens of filling that one join key spans.
BIN = 1 << 15
#: Simplex pivots at most; the plan is valid after any of them.
PIVOTS = 5000


# ---- tokens -------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    vocabulary = library.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
    return library, ends, {}


def words_of(text: str) -> list[str] | None:
    """The words that the vocabulary's own rules cut a text into; None where only the library itself knows: around
    special strings, and where a letter's lower case depends on what follows."""
    if "<|" in text:
        return None
    if text.isascii():
        return ASCII_WORDS(text.lower())
    if "\u03a3" in text:
        return None
    small = unicodedata.normalize("NFC", text).lower()
    return WORDS(small) if BEYOND_LATIN(small) else LATIN_WORDS(small)


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of whole texts, little-endian unsigned 32-bit integers. Words are independent of each other, so the library
    encodes each new one once."""
    library, ends, kept = _library(path)
    trim(kept, WORDS_KEPT)
    cut = list(map(words_of, texts))
    asked = list(set().union(*[ws for ws in cut if ws]).difference(kept))
    # Words of letters are encoded side by side; each ends with the only token that can end a word.
    letters = [w for w in asked if w.isalpha()]
    for i in range(0, len(letters), WORDS_AT_ONCE):
        some = letters[i : i + WORDS_AT_ONCE]
        ids = np.array(library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        packed = ids.tobytes()
        kept.update(zip(some, [packed[x:y] for x, y in zip([0, *stops], stops)], strict=True))
    alone = lambda some: [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(some, add_special_tokens=False)]
    others = [w for w in asked if w not in kept]
    kept.update(zip(others, alone(others)))
    out = [alone([text])[0] if ws is None else b"".join(map(kept.__getitem__, ws)) for text, ws in zip(texts, cut)]
    for word in asked:
        if len(word) > LONGEST_KEPT:
            del kept[word]
    return out


def _pieces(path: str, capacity: int, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = int(end).to_bytes(4, "little")
    for ids, texts in by_bytes(batches):
        tokens, cuts, filling = [], [], []
        for key, own in zip(ids.to_pylist(), encode_texts(path, texts)):
            own += last
            n = len(own) // 4
            tokens.append(n)
            if zlib.crc32(str(key).encode()) % FILLING == 0:
                cuts.append([])
                filling.append(own)
            else:
                spans = [(i, min(capacity, n - i)) for i in range(0, n, capacity)]
                cuts.append([{"start": i, "length": m, "crc": zlib.crc32(own[4 * i : 4 * (i + m)])} for i, m in spans])
                filling.append(None)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]))
        yield pa.record_batch(
            [ids, pa.array(tokens, pa.int64()), pa.array(cuts, kind), pa.array(filling, pa.binary())],
            names=["id", "doc_tokens", "pieces", "filling"],
        )


# ---- the plan: at most capacity / UNIT + FREQUENT classes, on the driver -----------------------------------------------------
def price(duals: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the greatest total value that fits, by dynamic programming over capacities."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        fits = np.flatnonzero(widths <= c)
        if len(fits):
            offered = value[c - widths[fits]] + duals[fits]
            best = int(offered.argmax())
            if offered[best] > value[c] + 1e-12:
                value[c], took[c] = offered[best], fits[best]
    pattern, c = np.zeros(len(widths), int), capacity
    while c > 0:
        if took[c] >= 0:
            pattern[took[c]] += 1
            c -= widths[took[c]]
        else:
            c -= 1
    return float(value[capacity]), pattern


def column_generation(widths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Fractional numbers of patterns (columns) that meet the demand with the fewest sequences."""
    basis = np.diag(capacity // widths).astype(float)
    amount = demand / np.diag(basis)
    for _ in range(PIVOTS):
        duals = np.linalg.solve(basis.T, np.ones(len(widths)))
        worth, pattern = price(duals, widths, capacity)
        if worth <= 1 + 1e-9:
            break
        rate = np.linalg.solve(basis, pattern.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(rate > 1e-9, amount / rate, np.inf)
        leaves = int(ratio.argmin())
        step = ratio[leaves]
        amount = np.maximum(amount - step * rate, 0)
        amount[leaves] = step
        basis[:, leaves] = pattern
    return basis.T.round().astype(int), amount


def classes_of(lengths: dict[int, int]) -> dict[int, int]:
    """length -> the greatest length of its class. Classes span UNIT tokens, but a length that many pieces have ends a
    class of its own, so pieces of frequent lengths are planned without rounding up."""
    total, ends = sum(lengths.values()), []
    for length in sorted(lengths):
        new = not ends or -(-length // UNIT) != -(-ends[-1] // UNIT) or lengths[ends[-1]] * FREQUENT >= total
        ends = [*ends, length] if new else [*ends[:-1], length]
    out, i = {}, 0
    for length in sorted(lengths):
        i += length > ends[i]
        out[length] = ends[i]
    return out


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, pieces of each class) for a histogram of lengths; every piece has a place. A class is
    named by its greatest length."""
    demand: dict[int, int] = {}
    for length, end in classes_of(lengths).items():
        demand[end] = demand.get(end, 0) + lengths[length]
    if not demand:
        return []
    ends = np.array(sorted(demand))
    widths = -(-ends // STEP)
    wanted = np.array([demand[c] for c in ends.tolist()])
    units = capacity // STEP
    patterns, amounts = column_generation(widths, wanted.astype(float), units)
    chosen: list[tuple[int, dict[int, int]]] = []
    left = wanted.copy()
    for pattern, amount in sorted(zip(patterns.tolist(), amounts.tolist()), key=lambda x: (-x[1], x[0])):
        used = np.array(pattern)
        n = int(min([np.floor(amount + 1e-6), *(left[used > 0] // used[used > 0])])) if used.any() else 0
        if n > 0:
            left -= n * used
            chosen.append((n, {int(c): int(k) for c, k in zip(ends, used) if k}))
    while left.any():  # the remainder, largest first: each pattern is used as often as it can be
        room, used = units, np.zeros_like(left)
        for i in range(len(ends) - 1, -1, -1):
            used[i] = min(left[i], room // widths[i])
            room -= used[i] * widths[i]
        n = int((left[used > 0] // used[used > 0]).min())
        left -= n * used
        chosen.append((n, {int(c): int(k) for c, k in zip(ends, used) if k}))
    return chosen


def places(chosen: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, ranks, first sequence, pieces of the class in a sequence, pieces before it) of each pattern."""
    rows, first, taken = [], 0, {}
    for n, pattern in chosen:
        before = 0
        for c in sorted(pattern, reverse=True):
            k = pattern[c]
            rows.append((c, taken.get(c, 0), n * k, first, k, before))
            taken[c] = taken.get(c, 0) + n * k
            before += k
        first += n
    return rows


# ---- the tables ---------------------------------------------------------------------------------------------------
def running_start(df: DataFrame, order: list[str], value: str, n: int, group: Column | None = None) -> DataFrame:
    """`df` with `from`: the sum of `value` over all rows before it. Rows are summed in blocks by a hash of the order
    columns, whose totals, one row per block, are summed in turn."""
    blocks = max(1, -(-n // RANKED_ROWS))
    df = df.withColumn("block", group if group is not None else F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    totals = df.groupBy("block").agg(F.sum(value).alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, "block")
        .withColumn("from", F.col("block_start") + F.col("inside"))
        .drop("block", "inside", "block_start")
    )


def _place(whole: DataFrame, lengths: dict[int, int], chosen: list, n: int) -> DataFrame:
    """Rank the pieces of each class and give each its sequence and its offset there."""
    spark = whole.sparkSession
    salts = max(1, -(-n // RANKED_ROWS))
    # A row per length: bounded by the capacity.
    names = F.broadcast(spark.createDataFrame(list(classes_of(lengths).items()) or [(0, 0)], "length long, class int"))
    salted = whole.join(names, "length").withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("class", "salt").count().select("class", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("class", "salt").orderBy(F.desc("length"), "id", "start", "crc")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(starts, ["class", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # Patterns times classes: bounded by the capacity, whatever the table.
    schema = "class int, first_rank long, ranks long, first_sequence long, k long, slot_before long"
    where = F.broadcast(spark.createDataFrame(places(chosen) or [(0, 0, 0, 0, 1, 0)], schema))
    at = F.col("rank") - F.col("first_rank")
    placed = ranked.join(where, "class").where((at >= 0) & (at < F.col("ranks")))
    placed = placed.select(
        "id", "start", "length", "crc", "doc_tokens",
        (F.col("first_sequence") + F.floor(at / F.col("k"))).alias("sequence_id"),
        (F.col("slot_before") + at % F.col("k")).alias("slot"),
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length()) if n >> b & 1]


def _fill(spark: SparkSession, filling: DataFrame, n_filling: int, total: int, gaps: DataFrame, n_gaps: int, room: int, first_new: int, capacity: int) -> DataFrame:
    """Cut the filling into the gaps and, beyond them, into new sequences: full ones, then powers of two."""
    laid = running_start(filling, ["id", "doc_tokens", "filling"], "doc_tokens", n_filling)
    blocks = max(1, -(-n_gaps // RANKED_ROWS))
    spaced = running_start(gaps, ["sequence_id"], "gap", n_gaps, F.floor(F.col("sequence_id") * blocks / max(1, first_new)).cast("int"))
    rows = spaced.select("sequence_id", "from", "gap", "used")
    over = max(0, total - room)
    full, rest = divmod(over, capacity)
    if full:
        rows = rows.unionByName(
            spark.range(full).select(
                (F.col("id") + first_new).alias("sequence_id"), (F.col("id") * capacity + room).alias("from"),
                F.lit(capacity).cast("bigint").alias("gap"), F.lit(0).cast("bigint").alias("used"),
            )
        )
    if rest:
        at, last = room + full * capacity, []
        for i, size in enumerate(_powers(rest)):
            last.append((first_new + full + i, at, size, 0))
            at += size
        rows = rows.unionByName(spark.createDataFrame(last, "sequence_id long, from long, gap long, used long"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor((b - 1) / BIN)))
    left = rows.withColumn("bin", bins(F.col("from"), F.col("from") + F.col("gap"))).withColumnRenamed("from", "g")
    right = laid.withColumn("bin", bins(F.col("from"), F.col("from") + F.col("doc_tokens")))
    begins = F.greatest("from", F.col("bin") * BIN)
    ends = F.least(F.col("from") + F.col("doc_tokens"), (F.col("bin") + 1) * BIN + capacity)
    right = right.select(
        "bin", "id", "doc_tokens", F.col("from").alias("f"), begins.alias("b"),
        F.substring("filling", (4 * (begins - F.col("from")) + 1).cast("int"), (4 * (ends - begins)).cast("int")).alias("part"),
    )
    a = F.greatest("g", "f")
    b = F.least(F.col("g") + F.col("gap"), F.col("f") + F.col("doc_tokens"))
    met = left.join(right, "bin").where((b > a) & (F.floor(a / BIN) == F.col("bin")))
    return met.select(
        "id", (a - F.col("f")).alias("start"), (b - a).alias("length"),
        F.crc32(F.substring("part", (4 * (a - F.col("b")) + 1).cast("int"), (4 * (b - a)).cast("int"))).alias("crc"),
        "doc_tokens", "sequence_id", (F.col("used") + a - F.col("g")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty) and `end`; each lies in one piece. Sequences hold at
    most `capacity` tokens. Repeated rows are packed each. An empty table gives no pieces. The driver sees only the
    histogram of lengths (`capacity` rows) and totals.
    """
    if capacity % UNIT:
        raise ValueError(f"capacity must be a multiple of {UNIT}")
    spark = docs.sparkSession
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("pieces", T._parse_datatype_string("array<struct<start:bigint,length:bigint,crc:bigint>>")),
            T.StructField("filling", T.BinaryType()),
        ]
    )
    read = materialize(small_batches(ids_and_texts(docs, id_col, text_col)).mapInArrow(partial(_pieces, path, capacity, end), schema))
    whole = read.where("filling IS NULL").select("id", "doc_tokens", F.explode("pieces").alias("p")).select("id", "doc_tokens", "p.*")
    lengths = {r[0]: r[1] for r in whole.groupBy("length").count().collect()}
    chosen = plan(lengths, capacity)
    n_sequences = sum(n for n, _ in chosen)
    placed = materialize(_place(whole, lengths, chosen, sum(lengths.values())))
    filling = read.where("filling IS NOT NULL").select("id", "doc_tokens", "filling")
    n_filling, total = filling.agg(F.count("*"), F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()
    gaps = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).select("sequence_id", "used", (capacity - F.col("used")).alias("gap")).where("gap > 0")
    n_gaps, room = gaps.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0))).first()
    filled = _fill(spark, filling, n_filling, total, gaps, n_gaps, room, n_sequences, capacity)
    every = placed.unionByName(filled)
    return every.select(F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
