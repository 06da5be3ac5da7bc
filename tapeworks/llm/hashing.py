"""Vectorized hashes of byte ranges, words and word windows for use inside Arrow tasks.

A range hash is a polynomial over the ring of 64-bit integers taken from prefix sums, then mixed; equal ranges always
hash alike, and n different ranges collide with probability about n * n / 2**65.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
SLICE = 2 << 20
#: bytes of texts whose words are hashed at once: each Python worker keeps tables of powers of up to 32 times this
HASHED = 1 << 18
#: bytes for steps that make many arrays of all positions: few enough that these stay in a core's cache
SMALL = 1 << 17
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values; another seed gives another order of the same values."""
    h = h + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**n and the same of its inverse, modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, HASHED + 1)
        got = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, U)
            a[0] = 1
            got.append(np.multiply.accumulate(a))
        if n < 4 * SLICE:
            _powers[base] = tuple(got)
    return got[0], got[1]


class RangeHash:
    """Hashes of any sub-ranges of one sequence of numbers."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        up, self.down = powers(n, base)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((values.astype(U) + U(1)) * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """The hashes of all windows of ``size``, in order, without looking up each start and end."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each text starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, most: int = SLICE):
    """Ranges of whole texts of about ``most`` bytes together; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words (runs without ASCII white space) and each text's first word."""
    inside = ~WHITE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[:-1][off[:-1] < len(buf)]
    first[cut] = inside[cut]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def word_hashes(buf: np.ndarray, off: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and each text's first word."""
    out, first = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    total = 0
    for i, j in slices(off, HASHED):
        part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
        start, end, w = word_spans(part, o)
        out.append(RangeHash(lower(part) if fold else part)(start, end))
        first.append(total + w[1:])
        total += len(start)
    return np.concatenate(out), np.concatenate(first)


def gram_parts(words: np.ndarray, first: np.ndarray, k: int):
    """What ``grams`` returns, for one range of whole texts after the other."""
    for i, j in slices(first, HASHED // 4):
        a, sizes = first[i], np.diff(first[i:j + 1]) - (k - 1)
        text = np.repeat(np.arange(i, j), np.maximum(sizes, 0))
        if not len(text):
            continue
        skip = np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))
        at = first[text] - a + np.arange(len(text)) - skip
        yield RangeHash(words[a:first[j]], GRAM_BASE)(at, at + k), at + a, text


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for each window of k words within a text, the position of its first word, and the text's number."""
    none = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(none, *gram_parts(words, first, k)))


def covered(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a window of the given length that starts at one of ``start``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    out, have = a, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
