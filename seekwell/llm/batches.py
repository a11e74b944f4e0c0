"""Arrow batch helpers shared by the operators that run Python."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes, that Spark hands to Python at once; a batch of long texts stays far below an executor's memory.
ROWS_AT_ONCE, BYTES_HANDED = 500, 8 << 20
#: UTF-8 bytes that a Python operator works on at once.
BYTES_AT_ONCE = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Ask for batches of at most ROWS_AT_ONCE rows and about BYTES_HANDED bytes (session settings that change no
    result)."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_HANDED)):
        now = str(conf.get(key)).rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; a null text is empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_bytes(batches: Iterator[pa.RecordBatch], at_once: int = BYTES_AT_ONCE) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) slices of about equal bytes; a text longer than that is a slice of its own."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        start = held = 0
        for i, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if held and held + size > at_once:
                yield ids.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += size
        if start < len(texts):
            yield ids.slice(start), texts[start:]


def trim(kept: dict, most: int) -> None:
    """Keep a worker's memory bounded: the older half of more than `most` entries goes."""
    if len(kept) > most:
        for key in list(islice(kept, len(kept) // 2)):
            del kept[key]
