"""Words of many texts at once: numpy over the bytes of an Arrow string column.

Texts are taken in slices of about ``SLICE`` bytes (a longer text is a slice of its own),
so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(4096, _BASE, dtype=np.uint64))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + SLICE, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def bounds(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (one more at the end)."""
    inside = is_word[buf]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offs[(offs > 0) & (offs < len(buf))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX1
        h = (h ^ (h >> np.uint64(27))) * _MIX2
        return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by blocks of words."""
    out = np.empty(len(s), dtype=np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(s):
            b = max(a + 1, int(np.searchsorted(e, s[a] + SLICE, "right")))
            n = e[a:b] - s[a:b]
            first = np.cumsum(n) - n  # where each word starts in the packed bytes
            pos = np.arange(int(n.sum()), dtype=np.int64)
            within = pos - np.repeat(first, n)
            byte = buf[within + np.repeat(s[a:b], n)].astype(np.uint64) + np.uint64(1)
            out[a:b] = np.add.reduceat(byte * _POW[within & 4095] ^ (byte << np.uint64(7)), first) + n.astype(np.uint64)
            a = b
    return mix(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    out = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _STEP + words[k:len(words) - width + 1 + k]
    return mix(out)


class Index:
    """Positions of 64-bit keys: an open-addressing table, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = keys
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several, one stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            got = self.slot[at]
            there = got >= 0
            todo, at, got = todo[there], at[there], got[there]
            same = self.keys[got] == keys[todo]
            out[todo[same]] = got[same]
            todo, at = todo[~same], (at[~same] + 1) & self.mask
        return out
