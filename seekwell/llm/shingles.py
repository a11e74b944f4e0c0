"""Word shingles of many texts at once, as 64-bit hashes, with array operations."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = U(0xD6E8FEB86659FD93)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (a fixed bijection)."""
    x = (x ^ (x >> U(32))) * STEP
    x = (x ^ (x >> U(29))) * BASE
    return x ^ (x >> U(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            factors = np.full(n, base, U)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts in order, A-Z in lower case, and the number of words of each text.

    Words are runs of anything but space and U+0009 to U+000D. A word's hash is a polynomial of its bytes, found from
    running sums over all bytes.
    """
    joined = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
    data = np.frombuffer(joined, np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    word = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]  # the last byte is a line break, so every word ends
    powers, inverses = _powers_to(len(data))
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * powers, dtype=U)])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)])))
    return hashes, counts


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: `width` words each, or all words of a text that has fewer."""
    hashes, counts = word_hashes(texts)
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        windows = hashes[:n]
        for k in range(1, width):
            windows = mix(windows * BASE + hashes[k : n + k])
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(windows[at : at + count - width + 1]))
        elif count:
            whole = hashes[at : at + 1]
            for k in range(1, count):
                whole = mix(whole * BASE + hashes[at + k : at + k + 1])
            out.append(mix(whole + U(count)))
        else:
            out.append(np.zeros(0, U))
        at += count
    return out
