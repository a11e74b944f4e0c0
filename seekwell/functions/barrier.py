"""Expressions that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column behind a generator of one row. The optimiser would otherwise copy `value` into each of its uses,
    which makes nested expressions grow with every level."""
    return df.select("*", F.explode(F.array(value)).alias(name))
