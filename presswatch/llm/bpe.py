"""Byte-level BPE with a segment tree, read from a public vocabulary file.

The tree stands over the adjacent pairs of one piece of text. A leaf holds ``rank * leaves + place`` of
its pair (or nothing, if the pair has no merge), a node the least of its two children, so the root names
the leftmost pair of lowest rank. A merge changes three leaves; each is carried up in logarithmic time;
the piece is done when the root is empty. Short pieces are worked on together, one row of a matrix each;
a long piece has a tree of its own, so a run of a million letters takes n log n steps.

Pieces come from the vocabulary's own splitting pattern, special tokens are cut out first. A task keeps
the ids of the pieces it has met, up to ``CACHE`` of them; then it starts a new store.
"""

from __future__ import annotations

import builtins
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The pattern that splits text into pieces before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 400_000
LONG = 64
NONE = np.int64(1 << 62)


def byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class PairTable:
    """Rank and merged id of a pair of ids, looked up for many pairs at once (open addressing)."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.zeros(1 << self.bits, dtype=np.int64)
        self.ids = np.zeros(1 << self.bits, dtype=np.int64)
        self.scalar = {}
        for rank, (left, right, merged) in enumerate(merges):
            key = left << 32 | right
            if key in self.scalar:
                continue
            self.scalar[key] = (rank, merged)
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ranks[at], self.ids[at] = key, rank, merged

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where it has no merge."""
        keys = left << 32 | right
        at = self._slot(keys)
        open_ = np.flatnonzero(self.keys[at] != keys)
        while len(open_):
            open_ = open_[self.keys[at[open_]] >= 0]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        return np.where(self.keys[at] == keys, at, -1)


class Vocabulary:
    """A byte-level BPE vocabulary with what encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, ids = file["model"], file["model"]["vocab"]
        names = byte_names()
        byte_of = {c: b for b, c in enumerate(names)}
        self.first = np.array([ids[c] for c in names], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("special tokens that take in neighbouring text are not supported")
        self.special = {c: i.to_bytes(4, "little") for c, i in added.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.token_bytes = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for text, i in [*ids.items(), *added.items()]:
            known = all(c in byte_of for c in text)
            self.token_bytes[i] = bytes(byte_of[c] for c in text) if known else text.encode()
        self.split = regex.compile(PATTERN).findall
        self.odd = re.compile(r" \s").search
        self.pieces: dict[str, bytes] = {}
        self.led: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    # Encoding.

    def _small(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merge many short pieces: ``rows`` has their byte ids, one piece a row; returns ids, -1 where none."""
        count, width = rows.shape
        leaves = 1 << max(0, int(width - 1).bit_length())
        symbols = np.full((count, leaves + 1), -1, dtype=np.int64)
        symbols[:, :width] = rows
        after = np.minimum(np.arange(1, leaves + 2)[None, :], sizes[:, None])
        after = np.where(after >= sizes[:, None], leaves, after)  # the place ``leaves`` is no symbol
        before = np.tile(np.arange(-1, leaves), (count, 1))
        tree = np.full((count, 2 * leaves), NONE, dtype=np.int64)
        s, a, b, t = symbols.ravel(), after.ravel(), before.ravel(), tree.ravel()

        def leaf(row: np.ndarray, place: np.ndarray) -> None:
            base = row * (leaves + 1)
            nxt = a[base + place]
            slot = self.pairs.look_up(s[base + place], s[base + nxt])
            good = (nxt < leaves) & (slot >= 0)
            t[row * 2 * leaves + leaves + place] = np.where(good, self.pairs.ranks[slot] * leaves + place, NONE)

        for place in range(width - 1):
            row = np.flatnonzero(sizes > place + 1)
            leaf(row, np.full(len(row), place))
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def carry(row: np.ndarray, place: np.ndarray) -> None:
            node, base = place + leaves, row * 2 * leaves
            while leaves > 1 and node[0] > 1:  # all nodes are on one level
                node = node >> 1
                t[base + node] = np.minimum(t[base + 2 * node], t[base + 2 * node + 1])

        rows_left = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows_left):
            base = rows_left * (leaves + 1)
            place = t[rows_left * 2 * leaves + 1] % leaves
            right = a[base + place]
            slot = self.pairs.look_up(s[base + place], s[base + right])
            s[base + place] = self.pairs.ids[slot]
            s[base + right] = -1
            following = a[base + right]
            a[base + place] = following
            b[base + following] = place
            t[rows_left * 2 * leaves + leaves + right] = NONE if leaves > 1 else t[rows_left * 2 + 1]
            inner = right < leaves
            leaf(rows_left, place)
            led = b[base + place] >= 0
            leaf(rows_left[led], b[base + place][led])
            if inner.any():
                carry(rows_left[inner], right[inner])
            carry(rows_left, place)
            if led.any():
                carry(rows_left[led], b[base + place][led])
            rows_left = rows_left[t[rows_left * 2 * leaves + 1] < NONE]
        return symbols[:, :leaves]

    def _long(self, data: bytes) -> list[int]:
        """Merge one long piece with a tree of its own."""
        scalar, n = self.pairs.scalar, len(data)
        s = self.first[np.frombuffer(data, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = 1 << (n - 1).bit_length()
        none = int(NONE)
        tree = [none] * (2 * leaves)

        def value(place: int) -> int:
            nxt = after[place]
            found = scalar.get(s[place] << 32 | s[nxt]) if nxt < n else None
            return none if found is None else found[0] * leaves + place

        def put(place: int, to: int) -> None:
            node = leaves + place
            tree[node] = to
            while node > 1:
                node >>= 1
                low, high = tree[2 * node], tree[2 * node + 1]
                tree[node] = low if low < high else high

        for place in range(n):
            tree[leaves + place] = value(place)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            place = tree[1] % leaves
            right = after[place]
            s[place] = scalar[s[place] << 32 | s[right]][1]
            s[right] = -1
            after[place] = after[right]
            if after[right] < n:
                before[after[right]] = place
            put(right, none)
            put(place, value(place))
            if before[place] >= 0:
                put(before[place], value(before[place]))
        return [x for x in s if x >= 0]

    def _learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of new pieces into the store."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if len(data) > LONG:
                self.pieces[piece] = np.array(self._long(data), dtype="<u4").tobytes()
            elif data:
                by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
        for width, group in by_width.items():
            for low in range(0, len(group), 1 << 14):
                part = group[low:low + (1 << 14)]
                sizes = np.array([len(d) for _, d in part])
                rows = np.frombuffer(b"".join(d.ljust(width, b"\0") for _, d in part), np.uint8).reshape(-1, width)
                ids = self._small(self.first[rows], sizes)
                shown = (ids >= 0) & (np.arange(ids.shape[1])[None, :] < sizes[:, None])
                flat, ends = ids[shown].astype("<u4").tobytes(), np.cumsum(shown.sum(axis=1)) * 4
                start = 0
                for (piece, _), end in zip(part, ends.tolist(), strict=True):
                    self.pieces[piece] = flat[start:end]
                    start = end

    def _cut(self, chunk: str, word: str) -> list[str]:
        """The pieces of a chunk; letters alone, or before one full stop or comma, need no pattern."""
        if word.isalpha():
            return [chunk]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return [chunk[:-1], word[-1]]
        return self.split(chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers.

        A space before a character that is no white space starts a new piece, whatever stands before it. So
        a text without a space followed by more white space is cut at its spaces, and the ids of each cut are
        kept as a whole; other texts are cut by the pattern alone.
        """
        if max(len(self.pieces), len(self.led)) > CACHE:
            self.pieces, self.led, self.bare = {}, {}, {}
        parts, plans = set(), []
        whole, led, bare = set(), set(), set()
        for text in texts:
            found = self.special_pattern.split(text) if self.special_pattern.search(text) else [text]
            plan = []
            for i, part in enumerate(found):
                if i % 2:
                    plan.append(("special", part))
                elif self.odd(part):
                    cut = self.split(part)
                    whole.update(cut)
                    plan.append(("pieces", cut))
                else:
                    cut = part.split(" ")
                    bare.add(cut[0])
                    led.update(cut[1:])
                    plan.append(("chunks", cut))
            plans.append(plan)
        cut_led = {c: self._cut(" " + c, c) for c in led.difference(self.led)}
        cut_bare = {c: self._cut(c, c) for c in bare.difference(self.bare)}
        parts.update(whole, *cut_led.values(), *cut_bare.values())
        self._learn(parts.difference(self.pieces))
        known = self.pieces.__getitem__
        for store, cuts in ((self.led, cut_led), (self.bare, cut_bare)):
            for chunk, cut in cuts.items():
                store[chunk] = b"".join(map(known, cut))
        out = []
        for plan in plans:
            ids = []
            for kind, cut in plan:
                if kind == "special":
                    ids.append(self.special[cut])
                elif kind == "pieces":
                    ids.extend(map(known, cut))
                else:
                    ids.append(self.bare[cut[0]])
                    ids.extend(map(self.led.__getitem__, cut[1:]))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, kept by the worker process for its later tasks."""
    kept = builtins.__dict__.setdefault("_presswatch_bpe", {})
    if path not in kept:
        kept[path] = Vocabulary(path)
    return kept[path]


def encoded(docs: DataFrame, path: str, text: str = "text", out: str = "ids",
            keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all) columns of ``docs`` and the array of ids of ``text``.

    Defined cases: a null or empty text has no ids; a column named like ``out`` is replaced; repeated rows
    stay. Every text is encoded whole.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    picked = docs.select(*names, F.col(text))
    schema = StructType([*docs.select(*names).schema.fields, *StructType.fromDDL(f"`{out}` array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids = words.encode([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<i4")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=[f.name for f in schema.fields])

    return picked.mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give a null text. A column named like ``out`` is replaced."""
    names = [c for c in df.columns if c.lower() != out.lower()]
    picked = df.select(*names, F.col(ids).alias(out))
    schema = StructType([*df.select(*names).schema.fields, *StructType.fromDDL(f"`{out}` string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [None if x is None else words.decode(x)
                         for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())],
                                                 names=[f.name for f in schema.fields])

    return picked.mapInArrow(run, schema)
