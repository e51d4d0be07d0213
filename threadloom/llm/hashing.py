"""Vectorised 64-bit hashes of words and of word sequences, shared by the word-based operators."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SEQUENCE_BASE = 0xD6E8FEB86659FD93
SEQUENCE_INVERSE = pow(SEQUENCE_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_VALUE[[9, 10, 11, 12, 13, 32]] = 0
#: Values of two bytes at once. Blanks count nothing and one lies between any two words, so no two bytes taken together are of two words.
_PAIR = (_VALUE[None, :] + _VALUE[:, None] * np.uint64(BASE)).ravel()
#: Pairs of bytes that are valued at a time, few enough to stay in a core's cache.
_PAIRS = 1 << 14


def power(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n-1 modulo 2**64, kept for the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort beats ``np.unique`` on 64-bit keys."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _word_starts(texts: list[bytes], joint: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with a blank between, where words start and where they stop."""
    flat = np.frombuffer(joint + joint.join(texts) + joint, dtype=np.uint8)
    blank = (flat - np.uint8(9)) < 5
    blank |= flat == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return flat, edge[::2], edge[1::2]


def _keys(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    pairs = flat[: len(flat) & ~1].view("<u2")  # a last odd byte is a blank
    steps = power(BASE * BASE & (1 << 64) - 1, len(pairs))
    before = np.zeros(len(pairs) + 1, dtype=np.uint64)  # running sums, modulo 2**64
    terms = before[1:]
    for lo in range(0, len(pairs), _PAIRS):
        own = terms[lo : lo + _PAIRS]
        np.take(_PAIR, pairs[lo : lo + _PAIRS], out=own, mode="clip")
        own *= steps[lo : lo + _PAIRS]
    np.cumsum(terms, out=terms)
    sums = np.empty(len(starts), dtype=np.uint64)
    first = before[starts >> 1]
    np.subtract(first[1:], first[:-1], out=sums[:-1])
    sums[-1:] = before[-1:] - first[-1:]
    sums *= power(INVERSE, len(flat))[starts]
    sums += (stops - starts).astype(np.uint64)
    return mix(sums)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words, in order, and the number of words of each text."""
    flat, starts, stops = _word_starts(texts, b" ")
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    counts = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    return _keys(flat, starts, stops), counts


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words, and the line each lies in, counted on through the texts."""
    flat, starts, stops = _word_starts(texts, b"\n")
    breaks = np.flatnonzero(flat == 10)
    return _keys(flat, starts, stops), np.repeat(np.arange(len(breaks)), np.diff(np.r_[np.searchsorted(starts, breaks), len(starts)]))


def sequence_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Keys of every ``width`` consecutive words (across texts; callers mask those)."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(words * power(SEQUENCE_BASE, len(words)))]
    n = len(words) - width + 1
    return mix((prefix[width:] - prefix[:-width]) * power(SEQUENCE_INVERSE, n))


def inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Whether the ``width`` words from each position lie in one text; for positions 0 .. n-width."""
    n = int(counts.sum())
    if n < width:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(n - width + 1) + width <= ends[: n - width + 1]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least of each ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    best, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = best[: len(best) - span], best[span:]
        best = np.where(values[left] <= values[right], left, right)
        span *= 2
    left, right = best[:n], best[width - span : width - span + n]
    return np.where(values[left] <= values[right], left, right)
