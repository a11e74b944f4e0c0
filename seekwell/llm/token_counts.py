"""Token counts: batch encoding in Arrow functions that returns lengths only.

Texts are cut at boundaries that no piece of the vocabulary can span, so each part is encoded once and its length
added up. Batches are balanced by bytes. Null texts count as empty; ids that are null or repeated are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seekwell.llm.batches import by_bytes, ids_and_texts, small_batches, trim

#: Lengths of parts seen before, kept by each Python worker. Beyond this the older half goes.
PARTS_KEPT = 400_000
#: Parts longer than this are encoded each time.
LONGEST_KEPT = 64
#: What stands for a space inside the vocabulary.
MARK = "▁"
#: A space after anything but a space: pieces have marks only in front, so none spans this place.
SAFE_CUT = re.compile(f"(?<=[^ {MARK}]) ")


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spanning = [
        p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARK in p.lstrip(MARK)
    ]
    # A dummy mark in front of every part and no other change of the text make parts independent.
    if spanning or model.encode("a  b\n", out_type=str)[:3] != [f"{MARK}a", MARK, f"{MARK}b"]:
        raise ValueError("this vocabulary has no safe boundaries at spaces")
    return model, {}


def safe_parts(text: str) -> list[str]:
    """The parts of a text whose token counts add up to the text's own."""
    if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    return SAFE_CUT.split(text)


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, kept = _library(path)
    for ids, texts in by_bytes(batches):
        trim(kept, PARTS_KEPT)
        parts = [safe_parts(text) for text in texts]
        new = list(set().union(*parts).difference(kept)) if parts else []
        fresh = dict(zip(new, map(len, model.encode(new, num_threads=1)))) if new else {}
        if "" in fresh:  # a single space at the end of a text, which is a token of its own
            fresh[""] = 1
        kept.update(fresh)
        n_tokens = [sum(map(kept.__getitem__, own)) for own in parts]
        for part in new:
            if len(part) > LONGEST_KEPT:
                del kept[part]
        yield pa.record_batch(
            [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64())],
            names=["id", "n_bytes", "n_tokens"],
        )


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: its id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    The plan is one scan and one Python node: no shuffle, memory bounded by a batch and the parts kept. The file at
    `model_path` must exist on every executor.
    """
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    counted = small_batches(ids_and_texts(docs, id_col, text_col)).mapInArrow(partial(_count, model_path), schema)
    return counted.selectExpr(f"id AS `{id_col}`", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} AS over_limit")
