"""BPE round trips, token counts and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from seekwell.llm import bpe, packing, token_counts  # noqa: E402

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [
    "a", "B", " ", "  ", "\n", "\t", "é", "é", "'s", "'RE", "12", "3", "#", "<|endoftext|>", "<|startoftext|>", "<s>", "　", "▁", "😀",
    "İ", "Σ", "ß", "the", " of", "\x1c", "\x85", "\xa0", " \n", "\x00", "中文", "thntblere", "---", "...",
]


def texts(n=1500):
    rng = random.Random(5)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]
    every = ["".join((chr(i), "a", chr(i), " b", chr(i), " ", chr(i))) for i in range(0, 0x3100)]
    return ["", " ", "\n", "a" * 5000, "word " * 20_000, "x" * 70 + " " + "y" * 70, *made, *every]


@pytest.fixture(scope="module")
def word_library():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte_library(word_library):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_byte_bpe_equals_the_library(byte_library):
    voc, given = bpe.Vocabulary(BYTE), texts()
    for text, mine, ref in zip(given, voc.encode_texts(given), byte_library.encode_batch(given, add_special_tokens=False)):
        assert np.frombuffer(mine, "<u4").tolist() == ref.ids, repr(text[:80])
        assert voc.decode(mine) == byte_library.decode(ref.ids, skip_special_tokens=False)


def test_bpe_verdicts_equal_exact_merging():
    voc = bpe.Vocabulary(BYTE)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, 3000), rng.integers(0, 50256, 3000)
    want = [voc.merge(voc.bytes_of[x] + voc.bytes_of[y]) == [x, y] for x, y in zip(a, b)]
    assert voc.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_long_words_merge_alike():
    voc = bpe.Vocabulary(BYTE)
    for word in (b"abab" * 16, b"thethe" * 10, bytes(range(60))):
        tokens = [voc.byte_ids[x] for x in word]
        assert voc._merge_short(list(tokens)) == voc._merge_long(list(tokens))


def test_decoding_repairs_bytes(byte_library):
    voc = bpe.Vocabulary(BYTE)
    ids = [voc.byte_ids[0xC3], 50256, voc.byte_ids[0xFF]]
    assert voc.decode(np.array(ids, "<u4").tobytes()) == byte_library.decode(ids, skip_special_tokens=False)


def test_op1_rows(spark, odd_docs, byte_library):
    got = bpe.round_trip_digests(odd_docs, BYTE).collect()
    rows = odd_docs.collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), len(e := byte_library.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    encoded = bpe.encode(odd_docs, BYTE)
    assert sorted(x.text for x in bpe.decode(encoded, BYTE).collect()) == sorted(r.text or "" for r in rows)


def test_op3_rows(spark, odd_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = token_counts.count_tokens(odd_docs, PIECE).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    model, given = sentencepiece.SentencePieceProcessor(model_file=PIECE), texts()
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PIECE).collect()}
    assert [got[i] for i in range(len(given))] == [len(x) for x in model.encode(given)]


def test_word_bpe_equals_the_library(word_library):
    given = texts()
    for text, mine, ref in zip(given, packing.encode_texts(WORD, given), word_library.encode_batch(given, add_special_tokens=False)):
        assert np.frombuffer(mine, "<u4").tolist() == ref.ids, repr(text[:80])


def packed(df, library, capacity=4096):
    """Check every promise of packing by hand; returns the padding and the pieces."""
    pieces = packing.pack(df, WORD, capacity).toPandas()
    rows = df.select("doc_id", "text").collect()
    wanted = [[*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows]
    assert pieces.length.sum() == sum(map(len, wanted))
    ids = {r.doc_id: np.array(w, "<u4") for r, w in zip(rows, wanted)}
    for p in pieces.itertuples():
        key = None if p.doc_id != p.doc_id else int(p.doc_id)
        own = ids[key]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
    copies = {k: sum(r.doc_id == k for r in rows) for k in ids}
    for key, own in pieces[pieces.doc_id.notna()].groupby("doc_id"):
        covered = np.zeros(len(ids[int(key)]), int)
        for p in own.itertuples():
            covered[p.start : p.start + p.length] += 1
        assert (covered == copies[int(key)]).all()
    padding = 0
    for _, own in pieces.groupby("sequence_id"):
        at = 0
        for p in own.sort_values("offset").itertuples():
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, pieces


def test_op2_odd_rows(spark, odd_docs, word_library):
    packed(odd_docs, word_library)


def test_op2_pads_little(spark, sf_dir, word_library):
    padding, pieces = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_library)
    assert padding < 0.05 * pieces.length.sum()


def test_op2_same_lengths(spark, word_library):
    df = spark.createDataFrame([(i, "the of and " * 100) for i in range(2000)], "doc_id long, text string")
    padding, pieces = packed(df, word_library)
    assert padding < 0.05 * pieces.length.sum()


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    for n in (1, 7, 500, 20_000):
        sizes = np.minimum(4096, rng.lognormal(6, 1.3, n).astype(int) + 1)
        lengths = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
        chosen = packing.plan(lengths, 4096)
        placed = {}
        for times, pattern in chosen:
            assert sum(c * k for c, k in pattern.items()) <= 4096
            for c, k in pattern.items():
                placed[c] = placed.get(c, 0) + times * k
        want = {}
        for length, end in packing.classes_of(lengths).items():
            assert length <= end < length + packing.UNIT
            want[end] = want.get(end, 0) + lengths[length]
        assert placed == want
    assert packing.plan({}, 4096) == []
    assert sum(n for n, _ in chosen) < 1.1 * sizes.sum() / 4096


def test_empty_tables(spark, no_docs):
    assert bpe.round_trip_digests(no_docs, BYTE).isEmpty()
    assert token_counts.count_tokens(no_docs, PIECE).isEmpty()
    assert packing.pack(no_docs, WORD).isEmpty()
