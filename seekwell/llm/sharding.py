"""Hilbert-curve ordering: quantise several metadata dimensions, sort by curve index, cut runs of equal length.

Files cut from such runs hold small boxes of every dimension at once, so filters on any of them skip most files.
DataFrame functions only.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.session import materialize

#: A group of equal texts that holds more than this fraction of the table is joined by broadcast.
HOT = 1024
#: Bits of each dimension; a curve over d dimensions has 2 ** (BITS * d) cells.
BITS = 4


@lru_cache(maxsize=8)
def curve(dims: int, bits: int = BITS) -> tuple[int, ...]:
    """The Hilbert index of every cell, by the cell's number (coordinates joined, the first in front).

    Each level of the curve visits the 2**d corners in Gray-code order, seen through the entry corner and direction
    of the sub-cube it is in; both follow from the corner just taken.
    """
    full, out = (1 << dims) - 1, []
    turn = lambda x, by: ((x >> by) | (x << (dims - by))) & full if by % dims else x
    ones = lambda x: ((x ^ (x + 1)) >> 1).bit_count()
    for cell in range(1 << (bits * dims)):
        at = [(cell >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
        entry = direction = index = 0
        for level in reversed(range(bits)):
            corner = sum(((at[d] >> level) & 1) << d for d in range(dims))
            code = turn(corner ^ entry, (direction + 1) % dims)
            step = code
            for shift in range(1, dims):
                step ^= code >> shift
            first = 2 * ((step - 1) // 2) if step else 0
            entry ^= turn(first ^ (first >> 1), (dims - direction - 1) % dims)
            direction = (direction + 1 + (ones(step if step % 2 else step - 1) if step else 0)) % dims
            index = (index << dims) | step
        out.append(index)
    return tuple(out)


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The curve index of integer coordinates in [0, 2 ** bits); the table of cells is a constant made by `curve`."""
    number = F.lit(0)
    for cell in cells:
        number = number * (1 << bits) + cell
    known = F.from_json(F.lit(str(list(curve(len(cells), bits)))), "array<int>")
    return F.get(known, number.cast("int"))


def quantile_bins(table: DataFrame, column: str, bits: int = BITS) -> list[tuple]:
    """(least value, number) of the bins but the first, at most 2 ** bits - 1 of them: about as many rows lie in each.

    Where there are no more different values than bins, each has one of its own, evenly spread. Values are counted before they are
    sorted, in range partitions with the partitions' totals, so a frequent one fills no task; only the ends of bins
    reach the driver. Nulls are no values.
    """
    bins = 1 << bits
    counts = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    run = materialize(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = run.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("values"))  # one row per partition
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("rows", "values")}
    every = totals.agg(F.sum("rows").alias("all_rows"), F.sum("values").alias("all_values"))
    own = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = run.join(F.broadcast(totals.withColumns(sums).drop("rows", "values").crossJoin(every)), "part")
    row = F.col("rows_before") + F.coalesce(F.sum("n").over(own), F.lit(0))
    rank = F.col("values_before") + F.coalesce(F.count("value").over(own), F.lit(0))
    of_own = F.col("all_values") <= bins
    # A value lies in the bin of its middle row.
    at = F.when(of_own, F.floor(rank * bins / F.col("all_values"))).otherwise(F.floor(bins * (row + F.col("n") / 2) / F.col("all_rows")))
    ends = placed.select("value", at.alias("bin")).groupBy("bin").agg(F.min("value").alias("least"))
    return sorted((r[0], int(r[1])) for r in ends.where("bin > 0").select("least", "bin").collect())


def bin_of(value: Column, bins: list[tuple]) -> Column:
    """The number of a value's bin; null has the first."""
    at = reduce(lambda rest, b: F.when(value >= F.lit(b[0]), F.lit(b[1])).otherwise(rest), bins, F.lit(0))
    return at.cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source"), carry: tuple[str, ...] = ()
) -> DataFrame:
    """Put every row of `docs` into shards 0 to `shards` - 1 whose counts differ by one at most (law `rows`).

    Returns the id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32, law, shard, slot (gapless from 0
    along the curve), grown_shard (null under this law), curve_index and a struct `carried` of the columns to `carry`,
    if any. Dimensions are `dims`, a column that is missing counting as null, and the size; each is cut into bins of
    about as many rows, which the data decide. Equal texts take the least values of `dims` among them, so they lie
    side by side and at most shards - 1 groups are cut. Without `carry` no text moves: only the narrow metadata is
    sorted, by a key that ends in the id and a number of the row, so no value, nor a repeated or null id, is too
    frequent for range partitioning. Ties along the curve go by size, text_crc32 and id. An empty table gives no rows,
    and other columns of `docs` aren't read, so their names can't clash.
    """
    name = lambda c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [f"d{i}" for i in range(len(dims))]
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    narrow = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            (F.octet_length(text).cast("bigint") + 8).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            *[name(c).alias(d) for c, d in zip(dims, own)],
            F.monotonically_increasing_id().alias("row"),
            *carried,
        )
    )
    # Groups of equal texts whose values differ. Groups are few rows each but one may be most of the table: it is one of
    # at most HOT groups then, which are broadcast.
    least = [F.min(F.coalesce(d, F.lit(""))).alias(f"{d}_least") for d in own]
    most = [F.max(F.coalesce(d, F.lit(""))).alias(f"{d}_most") for d in own]
    groups = narrow.groupBy("crc", "size").agg(F.count("*").alias("n"), *least, *most)
    differ = reduce(lambda x, y: x | y, [F.col(f"{d}_least") != F.col(f"{d}_most") for d in own], F.lit(False))
    mixed = materialize(groups.where(differ).select("crc", "size", "n", *[f"{d}_least" for d in own]))
    n = narrow.count()
    hot = F.broadcast(mixed.where(F.col("n") * HOT > n).drop("n"))
    cold = mixed.where(F.col("n") * HOT <= n).drop("n")
    key = ["crc", "size"]
    named = narrow.join(hot, key).unionByName(narrow.join(hot, key, "left_anti").join(cold, key, "left"))
    cells = [bin_of(F.coalesce(f"{d}_least", d), quantile_bins(narrow, d)) for d in own] + [bin_of(F.col("size"), quantile_bins(narrow, "size"))]
    placed = named.select("id", "size", "crc", "row", hilbert_index(cells).alias("at"), *(["carried"] if carry else []))
    # The place in a partition is written with the row, so later stages can't see another order.
    order = ["at", "size", "crc", "id", "row"]
    run = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("place", F.monotonically_increasing_id())
    run = materialize(run.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (  # one row per partition
        run.groupBy("part")
        .agg(F.count("*").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("n"))
    )
    rank, base, longer = F.col("start") + F.col("place"), F.expr(f"n div {shards}"), F.expr(f"n % {shards}")
    in_longer = rank < longer * (base + 1)
    shard = F.when(in_longer, F.floor(rank / (base + 1))).otherwise(longer + F.floor((rank - longer * (base + 1)) / F.greatest(base, F.lit(1))))
    first = shard * base + F.least(shard, longer)
    return run.join(F.broadcast(parts), "part").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (rank - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("at").cast("bigint").alias("curve_index"),
        *(["carried"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, **named) -> None:
    """Write all columns of `docs` as Parquet, a folder for each shard, rows along the curve. Files hold the least and
    greatest values of every column, so readers skip those that a filter rules out."""
    placed = shard_documents(docs, shards, carry=tuple(docs.columns), **named)
    placed.select("carried.*", F.col("shard").alias("__shard")).write.mode("overwrite").partitionBy("__shard").parquet(path)


def shards_touched(sharded: DataFrame, column: str) -> DataFrame:
    """(column, shards): in how many shards each value of a carried column stands, which is what a filter on it reads."""
    return sharded.groupBy(F.col("carried")[column].alias(column)).agg(F.count_distinct("shard").alias("shards"))
