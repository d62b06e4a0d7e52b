"""Texts of an Arrow batch as one byte array, and words in it, without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and their len + 1 offsets; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; a longer text is a range of its own."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        out.append((start, min(end, n)))
        start = out[-1][1]
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of its first word for each text (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    key, have = str(base), _POWERS.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[key] = have = np.multiply.accumulate(have)
    return have[:n]


#: Bytes that are hashed in one go; memory is about 32 times that.
PIECE = 1 << 18


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, by prefix sums of a polynomial, piece by piece.

    A word longer than a piece is hashed alone in steps, by the same polynomial.
    """
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + PIECE, "right"))
        if to <= at:
            out[at] = _long_hash(data[starts[at] : ends[at]])
            at += 1
            continue
        low, high = starts[at], ends[to - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_VALUES[data[low:high]] * _powers(_BASE, high - low), out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * _powers(_INVERSE, high - low)[a] + (b - a).astype(np.uint64) * np.uint64(_BASE >> 7)
        at = to
    return mix64(out)


def _long_hash(word: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for i in range(0, len(word), PIECE):
        part = word[i : i + PIECE]
        total += int(np.sum(_VALUES[part] * _powers(_BASE, len(part)))) * scale
        scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    return np.uint64((total + len(word) * (_BASE >> 7)) % (1 << 64))
