"""Running sums over arrays, inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one step of a running sum appends to at most; longer arrays are summed step by step.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(numbers: Column) -> Column:
    """The sum of all elements before each, appended one by one."""
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    none = state(F.lit(0).cast("bigint"), F.array().cast("array<bigint>"))
    return F.aggregate(numbers, none, lambda s, n: state(s["at"] + n, F.concat(s["out"], F.array(s["at"]))), lambda s: s["out"])


def running_starts(lengths: Column) -> Column:
    """For an array of longs, the sum of all elements before each.

    Each step of an aggregate copies what it has built so far, so sums are built for CHUNK elements at a time, from
    sums over the chunks; elements are read by their places, as slicing copies the whole array.
    """

    def over(x: Column) -> Column:
        last = F.size(x) - 1
        firsts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        chunks = F.transform(firsts, lambda i: F.transform(F.sequence(i, F.least(i + CHUNK - 1, last)), lambda k: F.get(x, k)))
        return let(chunks, lambda cs: F.flatten(F.zip_with(cs, _starts(F.transform(cs, _total)), lambda c, at: F.transform(_starts(c), lambda s: s + at))))

    return let(lengths, over)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, n: a + n)
