"""Byte-level BPE: speculate with greedy longest matches, verify every adjacent pair, merge exactly only what fails.

A sequence of tokens is the BPE encoding of its bytes when each token is the encoding of its own bytes and no merge
rule would have joined pieces across any of its boundaries. The second condition concerns two tokens at a time, so it
is checked for whole batches of distinct pairs with array operations. Words that fail are merged by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seekwell.llm.batches import by_bytes, ids_and_texts, small_batches, trim

#: How byte-level vocabularies split a text before merging (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and pair verdicts, that each Python worker keeps. Beyond this the older half goes.
WORDS_KEPT, PAIRS_KEPT = 800_000, 1_000_000
#: Longer words are encoded each time.
LONGEST_KEPT = 64
NONE = np.int64(1) << 40  # a rank after all others
_SPACE = r"[ \t\n\x0b\x0c\r]"
_NARROW = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\r0-9L]+|S+(?![^ \t\n\x0b\x0c\r])|S+".replace("S+", f"{_SPACE}+")
WORDS = regex.compile(PATTERN).findall
#: The same pattern for ASCII, and for ASCII with the letters of Latin-1.
ASCII_WORDS = re.compile(_NARROW.replace("L", "A-Za-z")).findall
LATIN_WORDS = re.compile(_NARROW.replace("L", r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff")).findall
BEYOND_LATIN = re.compile(r"[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]").search


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable bytes for themselves, the rest
    from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary with the arrays that the checks need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            if token not in self.special:
                self.bytes_of[i] = as_bytes(token)
        self.id_of = {b: i for i, b in enumerate(self.bytes_of) if b}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (ids[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.merges[a, b] = rank, made
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = a, b, rank
        pairs = sorted((a * self.size + b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pair_keys = np.array([k for k, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], np.int64)
        self.made = {a * self.size + b: made for (a, b), (_, made) in self.merges.items()}
        self.ranks = {a * self.size + b: rank for (a, b), (rank, _) in self.merges.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}  # the longest token that begins with three bytes
        for b in self.id_of:
            if len(b) > 2:
                self.longest[b[:3]] = max(self.longest.get(b[:3], 0), len(b))
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[int, bool] = {}  # verdicts on pairs, by left * size + right
        self.words: dict[str | int, bytes] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches from the left."""
        found, i, n, id_of, longest = [], 0, len(word), self.id_of.get, self.longest.get
        while i < n:
            j = i + longest(word[i : i + 3], 2)
            while (token := id_of(word[i:j])) is None:
                j -= 1
            found.append(token)
            i = min(j, n)
        return found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging the bytes of both together gives just these two.

        The merges that built both are undone from the last backwards. In each state the two pieces at the boundary
        could merge with each other; that happens if the rule comes before the next step of either side. Equal ranks
        go from left to right, so the boundary comes after the left piece's own merge and before the right one's.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(x), NONE)
        fits = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            p, q = x[live], y[live]
            key = p * self.size + q
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE) < before[live]
            fits[live[joins]] = False
            rp, rq = self.rank[p], self.rank[q]
            undo_left = rp > rq
            x[live] = np.where(undo_left, self.right[p], p)
            y[live] = np.where(undo_left, q, np.where(rq >= 0, self.left[q], q))
            before[live] = np.where(undo_left, rp, rq + 1)
            live = live[~joins & ((rp >= 0) | (rq >= 0))]
        return fits

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE of one word: lowest rank first, equal ranks from the left."""
        tokens = [self.byte_ids[b] for b in word]
        return self._merge_short(tokens) if len(tokens) <= LONGEST_KEPT else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        size, rank_of, made, last = self.size, self.ranks.get, self.made, int(NONE)
        ranks = [rank_of(a * size + b, last) for a, b in zip(tokens, tokens[1:])]
        while ranks and (least := min(ranks)) < last:
            i = ranks.index(least)
            tokens[i : i + 2] = [joined := made[tokens[i] * size + tokens[i + 1]]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(tokens[i - 1] * size + joined, last)
            if i < len(ranks):
                ranks[i] = rank_of(joined * size + tokens[i + 1], last)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a queue of merges, for words where scanning each time would be quadratic."""
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(m[0], i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (m := merges.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = merges[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((tokens[i], tokens[k])):
                    heapq.heappush(heap, (m[0], i, tokens[i], tokens[k]))
            if (h := before[i]) >= 0 and (m := merges.get((tokens[h], tokens[i]))):
                heapq.heappush(heap, (m[0], h, tokens[h], tokens[i]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Token ids of each word, and how many words needed exact merging."""
        proposed = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inside = owner[1:] == owner[:-1]
        keys = (flat[:-1] * self.size + flat[1:])[inside]
        distinct, where = np.unique(keys, return_inverse=True)
        known = self.known
        new = np.fromiter((k for k in distinct.tolist() if k not in known), np.int64)
        if len(new):
            known.update(zip(new.tolist(), self.compatible(new // self.size, new % self.size).tolist()))
        verdict = np.fromiter(map(known.__getitem__, distinct.tolist()), bool, len(distinct))
        trim(known, PAIRS_KEPT)
        failing = np.unique(owner[1:][inside][~verdict[where]]) if len(distinct) else []
        for i in failing:
            proposed[i] = self.merge(words[i])
        return proposed, len(failing)

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers, special tokens recognised where they stand."""
        kept, per_text = self.words, []
        for text in texts:
            own: list = []
            if self.special_split and any(s in text for s in self.special):
                for part in self.special_split.split(text):
                    own += [self.special[part]] if part in self.special else words_of(part)
            else:
                own = words_of(text)
            per_text.append(own)
        trim(kept, WORDS_KEPT)
        for i in self.special.values():
            kept[i] = i.to_bytes(4, "little")
        new = list(set().union(*per_text).difference(kept))
        encoded, _ = self.encode_words([w.encode() for w in new])
        buffer = np.fromiter(chain.from_iterable(encoded), "<u4").tobytes()
        ends = list(accumulate(4 * len(e) for e in encoded))
        kept.update((w, buffer[i:j]) for w, i, j in zip(new, chain((0,), ends), ends))
        out = [b"".join(map(kept.__getitem__, own)) for own in per_text]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del kept[word]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        found = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, found)).decode("utf-8", "replace")


def words_of(text: str) -> list[str]:
    """The words of a text, by the quickest pattern that says the same for its letters."""
    if text.isascii():
        return ASCII_WORDS(text)
    return WORDS(text) if BEYOND_LATIN(text) else LATIN_WORDS(text)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(path)
    for ids, texts in by_bytes(batches):
        yield pa.record_batch([ids, pa.array(voc.encode_texts(texts), pa.binary())], names=["id", "ids"])


def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(path)
    for batch in batches:
        texts = [voc.decode(x or b"") for x in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])


def _digest(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    voc = vocabulary(path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for ids, texts in by_bytes(batches):
        encoded = voc.encode_texts(texts)
        yield pa.record_batch(
            [
                ids,
                pa.array([len(e) // 4 for e in encoded], pa.int64()),
                pa.array(map(sha, encoded), pa.string()),
                pa.array([sha(voc.decode(e).encode()) for e in encoded], pa.string()),
            ],
            names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _mapped(df: DataFrame, fn, columns: dict[str, T.DataType], id_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", df.schema[0].dataType), *[T.StructField(k, v) for k, v in columns.items()]])
    return small_batches(df).mapInArrow(fn, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each whole text's ids as little-endian unsigned 32-bit integers. A null text is empty."""
    return _mapped(ids_and_texts(docs, id_col, text_col), partial(_encode, path), {"ids": T.BinaryType()}, id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from the rows of `encode`; null ids give an empty text."""
    return _mapped(encoded.select(id_col, ids_col), partial(_decode, path), {"text": T.StringType()}, id_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass without moving ids between processes: n_tokens and digests of both sides.

    One row per row of `docs`, repeated and null ids included; no shuffle.
    """
    columns = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return _mapped(ids_and_texts(docs, id_col, text_col), partial(_digest, path), columns, id_col)
