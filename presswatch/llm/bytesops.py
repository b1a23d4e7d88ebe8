"""Vectorised work on the UTF-8 bytes of an Arrow text column: words, hashes of spans, bounded slices.

Used inside Arrow tasks only. A slice holds whole texts, about ``SLICE_BYTES`` together (one longer
text is a slice of its own), so that the temporary arrays stay small at any batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_bytes = np.arange(256)
# Words of letters and digits: everything but ASCII punctuation, controls and capitals.
WORD_BYTES = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
# Words between ASCII white space.
SPACED_BYTES = ~((_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13)))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (from row, to row, bytes, offsets of each text in them); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, raw[at[low]:at[high]], at[low:high + 1] - at[low]
        low = high


def split_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of ``word`` bytes, and for each text the number of its first run."""
    inside = word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("forth")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("forth", _BASE), ("back", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["forth"], _POWERS["back"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    forth, back = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * forth[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each ``k`` consecutive word hashes, over the ends of texts too: the caller leaves those out."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + words[j:j + n]
    return mix(total ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def sum_spans(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``low:high`` of word hashes."""
    forth, back = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * forth[:len(words)], out=sums[1:])
    return mix((sums[high] - sums[low]) * back[low] + (high - low).astype(np.uint64))


class Tally:
    """Counts of 64-bit keys, added up in a task; ``full`` says when to hand them on."""

    def __init__(self, limit: int = 1 << 22):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > self.limit:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.held])
        counts = np.concatenate([c for _, c in self.held])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.add.reduceat(counts, at) if len(at) else counts

    def take(self, end: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """All counts so far, once they are many or at the end."""
        if not self.held or not (end or self.size > self.limit // 2):
            return None
        out, self.held, self.size = self.merged(), [], 0
        return out


class HashTable:
    """A number for each of many distinct 64-bit keys, looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.row = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.append(values, values.dtype.type(0))
        at, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.row[at[open_]] < 0]
            self.row[at[free]] = free
            open_ = open_[self.row[at[open_]] != open_]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        self.keys[at] = keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key (0 where it has none), and whether it has one."""
        at = self._slot(keys)
        row = self.row[at]
        open_ = np.flatnonzero((row >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            row[open_] = self.row[at[open_]]
            open_ = open_[(row[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return self.values[row], row >= 0


def sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
