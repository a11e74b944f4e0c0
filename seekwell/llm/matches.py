"""Regular-expression matches with their places, from built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekwell.functions.arrays import let, running_starts

NO_PLACES = "array<struct<start:bigint,end:bigint,text:string,value:string>>"


def gaps(text: Column, pattern: str) -> Column:
    """What lies before, between and after the leftmost non-overlapping matches."""
    return F.split(text, pattern, -1)


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """An array of (start, end, text, value) for the leftmost non-overlapping matches: code points, end exclusive.

    `value` is the text of `group`. A match starts after all gaps and matches before it, so places are running sums of
    lengths.
    """
    both = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda m, v: F.struct(m.alias("m"), v.alias("v")),
    )
    size = lambda x: F.coalesce(F.length(x).cast("bigint"), F.lit(0).cast("bigint"))

    def placed(pairs: Column) -> Column:
        # What starts after a match and its gap ends the match before.
        ends = F.slice(running_starts(F.zip_with(gaps(text, pattern), pairs, lambda g, p: size(g) + size(p["m"]))), 2, 1 << 30)
        return F.zip_with(
            pairs, ends, lambda p, end: F.struct((end - size(p["m"])).alias("start"), end.alias("end"), p["m"].alias("text"), p["v"].alias("value"))
        )

    return F.when(text.rlike(pattern), let(both, placed)).otherwise(F.array().cast(NO_PLACES))
