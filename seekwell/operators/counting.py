"""Counting the words of plain documents inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents, and their bytes, that Python gets at once; and rows that it returns at once, about.
DOCUMENTS_AT_ONCE, BYTES_AT_ONCE, ROWS_AT_ONCE = 500, 8 << 20, 1 << 16


def _counter(at_once: int) -> Callable:
    """The function of batches (id, lower-case text as bytes). It is made here so that it goes to the workers by value."""

    def count(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        # Every byte that isn't in X.WORD parts words, those of longer characters too
        parted = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))

        def rows(ids, at, words, tfs):
            """A row per word; at: the document of each group of words, and where it begins."""
            which, starts = (np.array(x, dtype=np.int64) for x in zip(*at))
            sizes = np.diff(np.append(starts, len(words)))
            tf = np.array(tfs, dtype=np.int64)
            square = tf.astype(np.float64)
            norm = np.repeat(np.add.reduceat(square * square, starts), sizes)
            own = ids.take(pa.array(np.repeat(which, sizes)))
            first = np.zeros(len(words), dtype=bool)
            for a, n in zip(starts.tolist(), sizes.tolist()):
                first[a + words[a : a + n].index(min(words[a : a + n]))] = True
            first &= ~np.asarray(own.is_null().to_numpy(zero_copy_only=False), dtype=bool)
            columns = [own, pa.array(words, pa.binary()).cast(pa.string()), pa.array(tf), pa.array(norm), pa.array(first)]
            made = pa.RecordBatch.from_arrays(columns, names=["doc_id", "w", "tf", "norm", "first"])
            for k in range(0, len(words), at_once):
                yield made.slice(k, at_once)

        for batch in batches:
            ids, at, words, tfs = batch.column(0), [], [], []
            for i, text in enumerate(batch.column(1)):
                counts = Counter((text.as_py() or b"").translate(parted).split())
                if counts:
                    at.append((i, len(words)))
                    words += counts
                    tfs += counts.values()
                if len(words) >= at_once:
                    yield from rows(ids, at, words, tfs)
                    at, words, tfs = [], [], []
            if words:
                yield from rows(ids, at, words, tfs)

    return count


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, w, tf, norm, first) of (doc_id, text): each word of X.WORD in a document's lower-case text once, with its count,
    the sum of the document's squared counts, and whether it is the least word of a document with an id. Rows aren't shuffled
    and a worker holds one batch of documents."""
    conf = docs.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", DOCUMENTS_AT_ONCE), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)):
        now = str(conf.get(key)).rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))  # changes no result
    texts = docs.select("doc_id", F.lower("text").cast("binary").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, w string, tf long, norm double, first boolean"
    return texts.mapInArrow(_counter(ROWS_AT_ONCE), schema)
