"""Words of many texts as arrays: positions and hashes, a few array operations for a whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    """Powers of an odd base (or its inverse) modulo 2 to the 64, at least n of them."""
    p = _powers[which]
    while len(p) < n:
        base = _BASE if which == "up" else pow(_BASE, -1, 1 << 64)
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        _powers[which] = p
    return p


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


#: Values of bytes: their numbers, and another choice for a second hash of the same bytes.
FIRST, SECOND = np.arange(1, 257, dtype=np.uint64), np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def prefix_sums(b: np.ndarray, value: np.ndarray = FIRST) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of value[byte] * base ** position over i <= position < j."""
    s = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value[b] * powers(len(b))[: len(b)], out=s[1:])
    return s


def span_hashes(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans lo to hi, equal for equal bytes wherever they stand."""
    return mix((sums[hi] - sums[lo]) * powers(len(sums), "down")[lo])


#: Bytes that are part of a word: ASCII letters and digits, and every byte of other characters.
WORD_BYTE = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and where each text's words begin (one more entry than texts)."""
    h, first, _, _, _ = placed_words(texts)
    return h, first


def placed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words; and each word's first byte and end among the texts joined by a newline, and those bytes."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    edge = np.diff(np.concatenate([[False], WORD_BYTE[b], [False]]).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(prefix_sums(b), lo, hi), np.searchsorted(lo, np.r_[0, np.cumsum(size)]), lo, hi, b


def batches(texts: list[bytes], most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def ngram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by the run's first word."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + w[k : len(w) - n + 1 + k]
    return mix(out)


def run_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """As ngram_hashes, from prefix sums: for long runs."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    s = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * powers(len(w))[: len(w)], out=s[1:])
    at = np.arange(len(w) - n + 1)
    return span_hashes(s, at, at + n)
