"""Exact top-k by inner product: the threshold algorithm over lists sorted by each dimension.

Rows are put in segments by falling length (norm) and queries into blocks. In a segment one list per dimension orders
its rows. A query reads its lists from their best ends, scores every row it meets in full, and stops when no row below
the depth reached could score as much as its kth result. Segments are searched in waves: a query brings the kth score
of the waves before, so it leaves out waves and segments, and stops in lists, whose bound is lower. Where reading on
would meet most rows of a segment anyway, the queries still open score it whole in one matrix product.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekwell.functions.barrier import once
from seekwell.operators.ranking import global_rank
from seekwell.session import materialize

#: Components that one side of a group holds, so its rows are this by the number of dimensions.
GROUP_COMPONENTS, LEAST_ROWS = 1 << 19, 64
#: Each wave has this many times the segments of the one before; the first has one.
GROWTH = 4
#: A query reads lists while this share of a segment's rows can't have been met by it.
READ_SHARE = 0.5
#: Bounds are rounded up by more than floating-point errors can amount to.
SLACK = 1 + 1e-9
#: Digits that an inner product of doubles can have.
LONGEST_SCORE = 700
Hit = tuple[int, int]


def _best(hits: list[Hit], k: int) -> list[Hit]:
    return sorted(hits, key=lambda x: (-x[0], x[1]))[:k]


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> list[Hit]:
    """The k best (score, id); only rows at least as good as the kth are sorted."""
    if scores.dtype != object and len(scores) > 4 * k:
        few = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, ids = scores[few], ids[few]
    return _best(list(zip(map(int, scores.tolist()), ids.tolist())), k)


def search(
    rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int, least: int | None = None, deepest: int | None = None, tally: list[int] | None = None
) -> list[Hit] | None:
    """The k best (score, id) of a segment for one query; ties go to the smaller id. `lists` orders rows upwards.

    With `least`, rows that score below it may be left out. None if the search isn't over at depth `deepest`. `tally`
    is given the numbers of rows scored.
    """
    n, used = len(rows), np.flatnonzero(query)
    seen = ids == own
    best: list[Hit] = []
    depth = 0
    while depth < n and not seen.all():
        if deepest is not None and depth >= deepest:
            return None
        to = min(n, max(k, 2 * depth))
        met = np.zeros(n, bool)
        for d in used:
            met[lists[n - to : n - depth, d] if query[d] > 0 else lists[depth:to, d]] = True
        if not len(used):  # every row scores zero and no list orders them
            met[:], to = True, n
        new = np.flatnonzero(met & ~seen)
        seen |= met
        if tally is not None:
            tally.append(len(new))
        best = _best([*best, *_top(rows[new] @ query, ids[new], k)], k)
        depth = to
        last = [lists[n - to, d] if query[d] > 0 else lists[to - 1, d] for d in used]
        goal = max([x for x in (best[-1][0] if len(best) == k else None, least) if x is not None], default=None)
        if goal is not None and len(used) and goal > rows[last, used] @ query[used]:
            break
    return best


def search_block(
    rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, owns: list[int], leasts: list[int | None], k: int
) -> tuple[list[list[Hit]], int]:
    """Of each query the k best of a segment, without those below its `least`, and how many scores were computed."""
    out: list[list[Hit]] = [[] for _ in owns]
    n, dims = rows.shape
    high, low = rows.max(0, initial=0), rows.min(0, initial=0)
    tops = np.maximum(queries, 0) @ high + np.minimum(queries, 0) @ low if dims else np.zeros(len(owns))
    open_ = [i for i, x in enumerate(leasts) if x is None or tops[i] >= x]
    # At this depth a query could have met READ_SHARE of the rows.
    deepest = int(READ_SHARE * n / max(1, dims))
    rest, tally = open_, []
    if deepest >= k and open_:
        lists, rest = np.argsort(rows.astype(np.float64), axis=0, kind="stable").astype(np.int32), []
        for i in open_:
            found = search(rows, ids, lists, queries[i], owns[i], k, leasts[i], deepest, tally)
            if found is None:
                rest.append(i)
            else:
                out[i] = found
    at_once = max(1, (4 * GROUP_COMPONENTS) // max(1, n))
    for j in range(0, len(rest), at_once):
        some = rest[j : j + at_once]
        for i, scores in zip(some, queries[some] @ rows.T):
            others = ids != owns[i]
            out[i] = _top(scores[others], ids[others], k) if not others.all() else _top(scores, ids, k)
    for i, x in enumerate(leasts):
        if x is not None:
            out[i] = [hit for hit in out[i] if hit[0] >= x]
    return out, sum(tally) + len(rest) * n


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    joined = column.combine_chunks()
    joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
    return joined.flatten().to_numpy(zero_copy_only=False).reshape(len(joined), -1)


def exact_pair(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in a type in which every inner product is exact: floats, longs, or Python's integers."""
    most = max(1, rows.shape[1]) * float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if most < 2**52:
        return rows, queries
    if most < 2**62:
        return rows.astype(np.int64), queries.astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    return whole(rows), whole(queries)


def _group(k: int, _key: tuple, segment: pa.Table, block: pa.Table) -> pa.Table:
    out: list[tuple[int, int, int, str]] = []
    if segment.num_rows and block.num_rows:
        rows, queries = exact_pair(_matrix(segment["v"]), _matrix(block["v"]))
        owns, uids = block["vec_id"].to_pylist(), block["uid"].to_pylist()
        leasts = [None if x is None else int(x) for x in block["least"].to_pylist()]
        found, _ = search_block(rows, segment["vec_id"].to_numpy(), queries, owns, leasts, k)
        out = [(uid, own, other, str(score)) for uid, own, hits in zip(uids, owns, found) for score, other in hits]
    ids = {c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("uid", "query_id", "vec_id"))}
    return pa.table(ids | {"score": pa.array([r[3] for r in out], pa.string())})


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, dims) with v = floor(scale * x) of each component, of the vectors that take part. Components stay
    doubles, which hold such integers of any size."""
    v = F.col(f"`{vector_col}`")
    scaled = F.transform(v, lambda x: F.lit(float(scale)) * x.cast("double"))
    good = F.forall(scaled, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    usable = F.when(v.isNotNull() & F.col(f"`{id_col}`").isNotNull() & good, scaled)
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)
    return (
        vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), usable.alias("v"))
        .where("v IS NOT NULL")
        .select("vec_id", F.transform("v", whole).alias("v"), F.size("v").alias("dims"))
    )


def _score() -> Column:
    """Scores travel as text, as they may be longer than any number type; they are ordered by sign, length and digits."""
    score, negative = F.col("score"), F.col("score").startswith("-")
    digits = F.when(negative, F.substring(score, 2, 1 << 30)).otherwise(score)
    padded = F.lpad(digits, LONGEST_SCORE, "0")
    return F.when(negative, F.concat(F.lit("-"), F.translate(padded, "0123456789", "9876543210"))).otherwise(padded)


def _kept(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("uid").orderBy(F.desc(_score()), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best other rows for each row whose id is divisible by `every`: query_id, rank (from 1), vec_id, score.

    Vectors that are null, or hold null or non-finite components, and rows without an id take no part; components of
    any size do, and scores are exact. A score beyond the range of a long is ranked by its true value and shown as the
    nearest long. Vectors meet only those of their own length. Rows with a query's id are its own and never answers; a
    repeated query row gets a ranking of its own, repeated candidates are candidates each, and ties go to the smaller
    id. An empty table gives no rows; no other column of `vectors` is read. Groups have a fixed size, so no id or value
    can fill a task; in each wave a row moves once per block of open queries, and a query once per segment.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    # The length, without overflow in between.
    rows = once(rows, "m", F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))
    norm = F.col("m") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.nullif(F.col("m"), F.lit(0.0))) * (x / F.col("m"))))
    numbered = materialize(rows.select("vec_id", "v", "dims", F.coalesce(norm, F.lit(0.0)).alias("norm"), F.monotonically_increasing_id().alias("uid")))
    is_query = F.col("vec_id") % every == 0
    n, n_queries, most = numbered.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max("dims"), F.lit(1))).first()
    size = max(LEAST_ROWS, GROUP_COMPONENTS // max(1, most))
    ranked = global_rank(numbered.withColumn("shorter", -F.col("norm")), ["shorter", "uid"], "at").drop("shorter")
    ranked = ranked.withColumn("segment", F.floor(F.col("at") / size).cast("int"))
    blocks = max(1, -(-n_queries // size))
    queries = materialize(ranked.where(is_query).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")))
    best = found = queries.sparkSession.createDataFrame([], "uid long, query_id long, vec_id long, score string")
    first, width, keys = 0, 1, ["dims", "segment", "block"]
    while n_queries and first * size < n:
        wave = ranked.where((F.col("segment") >= first) & (F.col("segment") < first + width))
        longest = wave.agg(F.max("norm")).first()[0]
        kth = best.where(F.col("rank") == k).select("uid", F.col("score").alias("least")) if first else best.select("uid", F.col("score").alias("least"))
        # No row of the wave scores more than the product of the lengths.
        reach = F.col("norm") * F.lit(longest) * F.lit(SLACK)
        open_ = queries.join(kth, "uid", "left").where(F.col("least").isNull() | (F.col("least").cast("double") <= reach))
        spread = lambda x, y: F.explode(F.sequence(F.lit(x), F.lit(y - 1)))
        segments = min(first + width, -(-n // size))
        left = wave.select("dims", "segment", spread(0, blocks).alias("block"), "vec_id", "v")
        right = open_.select("dims", spread(first, segments).alias("segment"), "block", "vec_id", "uid", "v", "least")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(partial(_group, k), "uid long, query_id long, vec_id long, score string")
        best = materialize(_kept(best.select(*found.columns).unionByName(found), k))
        first, width = segments, width * GROWTH
    if not n_queries:
        best = _kept(best, k)
    ends = F.when(F.col("score").startswith("-"), F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1))
    shown = F.coalesce(F.expr("try_cast(score AS bigint)"), ends)
    return best.select("query_id", "rank", "vec_id", shown.alias("score"))
