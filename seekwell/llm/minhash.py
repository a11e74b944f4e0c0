"""Near-duplicates by MinHash: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A text's signature has CHUNKS chunks of SLOTS minima, of which BITS bits each are kept; a chunk fills one long. Two
signatures that differ in fewer than CHUNKS * (ERRORS + 1) slots have, by the pigeonhole principle, a chunk in which at
most ERRORS slots differ. Each chunk is therefore indexed once for every slot that may be wrong, with that slot blanked
out, and every such pair meets under some key. Pairs further apart mostly meet too: at the similarity threshold of 0.8
a pair is missed with a probability of 3 in a million.

Texts with the same set become one class first. In each bucket of the index, classes are compared with the bucket's
least class, then those outside its largest component with a few members of that, which joins what belongs together;
then all pairs whose components still differ are compared. So every candidate pair is either compared or already
linked, and a bucket of n near copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.llm.batches import by_bytes, ids_and_texts, small_batches
from seekwell.llm.components import components
from seekwell.llm.shingles import U, mix, shingle_sets
from seekwell.session import materialize

CHUNKS, SLOTS, BITS, ERRORS = 12, 6, 10, 1
#: Keys of a signature: one for each slot that may be wrong.
KEYS = CHUNKS * SLOTS
#: Members of a bucket's largest component that its other rows are compared with before all are.
HUBS = 4
#: Differing slots beyond which a pair isn't confirmed: 5.5 standard deviations above the mean at similarity 0.8.
FARTHEST = 33
#: Rows of a bucket that one task compares with as many others.
BLOCK_ROWS = 2048
_MULTIPLIERS = mix(np.arange(1, CHUNKS * SLOTS + 1, dtype=U)) | U(1)


def _lanes(value: int) -> int:
    """A value repeated in every slot of a chunk."""
    return sum(value << (BITS * s) for s in range(SLOTS))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The chunks of a set's b-bit MinHash signature."""
    least = np.full(CHUNKS * SLOTS, np.iinfo(U).max, U)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[i : i + 4096, None] * _MULTIPLIERS).min(0), out=least)
    kept = (mix(least) >> U(64 - BITS)).reshape(CHUNKS, SLOTS)
    return (kept << (U(BITS) * np.arange(SLOTS, dtype=U))).sum(1, dtype=U).view(np.int64)


def _sign(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in by_bytes(batches):
        sets = shingle_sets(texts, width)
        chunks = np.stack([signature(s) for s in sets])
        total = lambda f: pa.array(np.array([f(s).sum(dtype=U) for s in sets], U).view(np.int64))
        yield pa.record_batch(
            [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                total(lambda s: s),
                total(lambda s: mix(s ^ U(0x5DEECE66D))),
                pa.ListArray.from_arrays(np.arange(0, CHUNKS * len(sets) + 1, CHUNKS, dtype=np.int32), chunks.ravel()),
            ],
            names=["id", "n", "h1", "h2", "sig"],
        )


def differing(a: Column, b: Column) -> Column:
    """In how many slots two chunks differ: slots whose exclusive or isn't zero carry into their top bit."""
    low, top = F.lit(_lanes((1 << (BITS - 1)) - 1)), F.lit(_lanes(1 << (BITS - 1)))
    x = a.bitwiseXOR(b)
    return F.bit_count(((x.bitwiseAND(low) + low).bitwiseOR(x)).bitwiseAND(top))


def _index(classes: DataFrame) -> DataFrame:
    """A row per class and key: a chunk with one slot blanked out, hashed. The key's remainder by KEYS is the number of
    the blank."""
    blanked = lambda c, j: F.col("sig")[c].bitwiseAND(F.lit(((1 << 63) - 1) & ~(((1 << BITS) - 1) << (BITS * j))))
    hashed = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(i), blanked(*divmod(i, SLOTS))), 8) * KEYS + i
    return classes.select("id", F.explode(F.array(*map(hashed, range(KEYS)))).alias("key"))


def _alike(percent: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sets are similar enough, counted exactly."""
    held: tuple[str, np.ndarray] = ("", np.zeros(0, U))  # neighbouring rows often share a hub
    for batch in batches:
        us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right, kept = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
        for i, (a, b) in enumerate(zip(left, right)):
            if held[0] != b:
                held = (b, shingle_sets([b], width)[0])
            x, y = shingle_sets([a], width)[0], held[1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                kept.append(i)
        yield pa.record_batch([pa.array([us[i] for i in kept], pa.int64()), pa.array([vs[i] for i in kept], pa.int64())], names=["u", "v"])


def _mark(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in by_bytes(batches):
        bits = [bitmap(s) for s in shingle_sets(texts, width)]
        ends = np.cumsum([0, *map(len, bits)]).astype(np.int32)
        yield pa.record_batch([ids, pa.ListArray.from_arrays(ends, np.concatenate(bits))], names=["id", "bits"])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A set as bits: each shingle sets one of 4 to 8 times as many bits as there are shingles, a power of two."""
    size = 1 << max(6, int(4 * max(1, len(shingles)) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(mix(shingles) & U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_common(n: Column, m: Column, a: Column, b: Column) -> Column:
    """An upper bound of the intersection of two sets of n and m shingles with bitmaps a and b.

    A bit of only one bitmap shows a shingle of only one set, so no pair is lost by this bound. Of bitmaps of unequal
    length the longer is folded to the other's.
    """

    def folded(x: Column, y: Column) -> Column:
        half = F.size(x) / F.lit(2)
        return F.when(
            F.size(x) > F.size(y),
            F.zip_with(F.slice(x, F.lit(1), half.cast("int")), F.slice(x, half.cast("int") + 1, half.cast("int")), lambda p, q: p.bitwiseOR(q)),
        ).otherwise(x)

    x, y = folded(a, b), folded(b, a)
    ones = lambda z: F.aggregate(z, F.lit(0), lambda t, p: t + F.bit_count(p))
    both = ones(F.zip_with(x, y, lambda p, q: p.bitwiseAND(q)))
    return F.least(n - ones(x) + both, m - ones(y) + both)


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The links among pairs (u, v), checked on the sets of whole texts. Texts are joined by shuffling at any size; a hub
    with very many pairs makes a partition that adaptive execution splits."""
    side = lambda name, text: texts.select(F.col("id").alias(name), F.col("text").alias(text)).hint("merge")
    rows = small_batches(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b"))
    return materialize(rows.mapInArrow(partial(_alike, percent, width), "u long, v long"))


def _near(n: Column, m: Column, percent: int) -> Column:
    """Sets whose sizes alone don't rule the similarity out."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _apart(a: Column, b: Column) -> list[Column]:
    """The differing slots of each chunk."""
    return [differing(a[c], b[c]) for c in range(CHUNKS)]


def _total(counts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, counts)


def _within(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures allow a link."""
    about = lambda side: classes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
    near = _near(F.col("n_u"), F.col("n_v"), percent) & (_total(_apart(F.col("sig_u"), F.col("sig_v"))) <= FARTHEST)
    return pairs.join(about("u"), "u").join(about("v"), "v").where(near).select("u", "v")


def _ordered(u: Column, v: Column) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _open_rows(buckets: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several components, with the largest of these and the number of blocks that
    a bucket is dealt into."""
    placed = buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = (
        placed.groupBy("key", "component")
        .agg(F.count("*").alias("size"))
        .groupBy("key")
        .agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("size").alias("rows"))
        .where("parts > 1")
        .select("key", "largest", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    return materialize(placed.join(materialize(mixed), "key").join(classes.select("id", "n", "sig"), "id"))


def _to_hubs(rows: DataFrame) -> DataFrame:
    """Pairs of the rows outside a bucket's largest component with HUBS members of it, taken by different hashes."""
    inside = F.col("component") == F.col("largest")
    hubs = materialize(
        rows.where(inside)
        .groupBy("key")
        .agg(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(s))) for s in range(HUBS)]).alias("hubs"))
        .withColumn("hubs", F.array_distinct("hubs"))
    )
    return rows.where(~inside).join(hubs, "key").select(F.col("id").alias("u"), F.explode("hubs").alias("v")).distinct()


def _crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Every pair in a bucket whose components differ, sizes, signatures and bitmaps allowing a link. One of the two is outside
    the bucket's largest component, so the rows of that component aren't compared with each other. A bucket of many rows
    is a grid of blocks: a task compares two blocks, however many texts share a key without being linked."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(name: str) -> DataFrame:
        at = {"u": (own, every), "v": (every, own)}[name]
        return rows.select(
            F.col("key").alias(f"key_{name}"), at[0].alias(f"row_{name}"), at[1].alias(f"column_{name}"),
            *[F.col(x).alias(f"{x}_{name}") for x in ("id", "component", "n", "sig", "bits")], *(["largest"] if name == "u" else []),
        )

    errors = _apart(F.col("sig_u"), F.col("sig_v"))
    # Each pair once: in its first chunk that fits, and there at the first blank if no slot differs. The key's low bits
    # tell the chunk and the blank.
    chunk = F.floor(F.pmod(F.col("key_u"), F.lit(KEYS)) / SLOTS).cast("int")
    blank = F.pmod(F.pmod(F.col("key_u"), F.lit(KEYS)), F.lit(SLOTS))
    here = differing(F.get("sig_u", chunk), F.get("sig_v", chunk))
    first = reduce(lambda x, y: x & y, [(chunk <= c) | (errors[c] > ERRORS) for c in range(CHUNKS)])
    bound = most_common(F.col("n_u"), F.col("n_v"), F.col("bits_u"), F.col("bits_v"))
    wanted = (
        (F.col("component_u") != F.col("component_v"))
        & ((F.col("component_v") == F.col("largest")) | (F.col("id_u") < F.col("id_v")))
        & _near(F.col("n_u"), F.col("n_v"), percent)
        & (here <= ERRORS)
        & ((here > 0) | (blank == 0))
        & first
        & (_total(errors) <= FARTHEST)
        & (bound * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent)
    )
    u, v = side("u").where("component_u <> largest"), side("v")
    met = (F.col("key_u") == F.col("key_v")) & (F.col("row_u") == F.col("row_v")) & (F.col("column_u") == F.col("column_v"))
    return u.join(v, met & wanted).select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the least id reachable over links) and kept.

    Two texts are linked if 100 * intersection >= `percent` * union of their sets of `width`-word shingles. A text
    with fewer words has one shingle of all its words; one without words, or null, has none and is linked with
    nothing. Ids are integers that name a text; rows that repeat one must be equal, and each is returned. Rows without
    an id are kept, in no component. An empty table gives no rows; no other column of `docs` is read, so names can't
    clash. A text is hashed whole, with memory in proportion to the longest one.
    """
    read = ids_and_texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("bigint"))
    signed = materialize(small_batches(read).mapInArrow(partial(_sign, width), "id long, n long, h1 long, h2 long, sig array<long>"))
    same = ["h1", "h2", "n"]
    classes = materialize(
        signed.where("n > 0 AND id IS NOT NULL")
        .groupBy(*same)
        .agg(F.min_by(F.struct("id", "sig"), "id").alias("x"))
        .select(*same, "x.id", "x.sig")
    )
    shared = materialize(_index(classes).groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"))
    buckets = materialize(_index(classes).join(shared, "key"))
    texts = materialize(read.join(buckets.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"]))
    hubs = materialize(buckets.groupBy("key").agg(F.min("id").alias("hub")))
    stars = buckets.join(hubs, "key").where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    compared = materialize(_within(stars, classes, percent))
    links = _confirm(compared, texts, percent, width)
    found = materialize(components(links).withColumnRenamed("node", "id"))
    for step in ("hubs", "all"):
        rows = _open_rows(buckets, found, classes)
        if rows.isEmpty():
            break
        if step == "hubs":
            pairs = _within(_to_hubs(rows), classes, percent)
        else:
            marks = small_batches(texts).mapInArrow(partial(_mark, width), "id long, bits array<long>")
            pairs = _crossing(rows.join(marks, "id"), percent)
        pairs = materialize(pairs.select(*_ordered(F.col("u"), F.col("v"))).distinct().join(compared, ["u", "v"], "left_anti"))
        more = _confirm(pairs, texts, percent, width)
        compared = compared.unionByName(pairs)
        if not more.isEmpty():
            stars = found.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
            found = materialize(components(more.unionByName(stars)).withColumnRenamed("node", "id"))
    named = materialize(classes.join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component")))
    out = signed.select("id", *same).join(named, same, "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
