"""Periodic run detection over words with an enhanced suffix array (suffix array, LCP, inverse).

Words are runs of characters other than space and \\t-\\r, numbered from 0. A run is a stretch of words with
smallest period q (words q apart are equal), at least ``max(MIN_LENGTH, 2q)`` words long, that no neighbouring
word extends with period q. Method, per document (no tree nodes are built):

1. Words become integer ids; the suffix array comes from prefix doubling (numpy sorts), the LCP array from
   the doubling ranks by binary lifting, the inverse suffix array by a scatter.
2. One pass over the LCP array with a stack yields every lcp-interval [lb, rb] of depth D > 0 and its child
   boundaries. For each suffix i in a child other than the largest, the branching-tandem test looks up
   ISA[i + D] and ISA[i - D]: a hit inside [lb, rb] is a square of period D at i (or at i - D); it is branching
   when the word after it breaks the period. Every branching square is found this way (Stoye and Gusfield's
   smaller-half rule), with O(n log n) lookups, done with numpy over all intervals at once.
3. A branching square with a primitive root is the right end of exactly one run of its period: it is rotated
   left while the period holds, which gives the run's start. Squares with a root that is a power are left
   out (their stretch has a smaller period).

A word is dropped when a run holds it after that run's first q words; the collapsed text is the kept words
joined by one space. Documents without a repeated 6-gram of words have no run (a run of length at least 12
and period q repeats the 6 words at its start q words later), so they skip step 1 to 3.

Before the search, the query's damage turns the tail of some documents periodic (see ``damaged_words``).
Defined cases: a null text has no words, no runs and an empty collapsed text; a null id is not damaged; texts
of any length are read whole; repeated rows give equal results; other columns are kept, but the result's
columns replace columns of the same name (compared without case).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.llm.common import fresh, small_batches

MIN_LENGTH = 12
SHINGLE = 6
# Fixed values of the contract's damage: h = crc32(decimal id); h mod 10 = 0 makes the tail periodic.
DAMAGE_MOD, PERIOD_BASE, PERIOD_SPREAD = 10, 3, 8
_SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
RUN = "struct<start:long,length:long,period:long>"


def split_words(text: str | None) -> list[str]:
    """The words of a text: runs of characters other than space and \\t-\\r."""
    return [w for w in (text or "").translate(_SPACES).split(" ") if w]


def damage_hash(doc_id: int | None) -> int | None:
    """h of the damage: crc32 of the decimal id, unsigned (None for a null id)."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def damaged_words(h: int | None, words: list[str]) -> list[str]:
    """The contract's damage: with g = h // 10, when h % 10 = 0 and n > 0, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). A null h leaves the words."""
    n = len(words)
    if h is None or n == 0:
        return words
    g = h // DAMAGE_MOD
    if h % DAMAGE_MOD:
        return words
    a = g % n
    p = 1 + (n - a) // (PERIOD_BASE + g % PERIOD_SPREAD)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, with the rank array of each level (prefixes of 2^j words)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[:n - k] = rank[k:] if k < n else second[:0]
        order = np.lexsort((second, rank))
        first_s, second_s = rank[order], second[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[0, (first_s[1:] != first_s[:-1]) | (second_s[1:] != second_s[:-1])])
        rank, k = new, k * 2
        levels.append(rank)
        if rank.max() == n - 1 or k >= n:
            sa = np.empty(n, dtype=np.int64)
            sa[rank] = np.arange(n)
            return sa, levels


def lcp_array(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP[k] = common prefix of suffixes sa[k - 1] and sa[k] (LCP[0] = 0), by binary lifting over the levels."""
    n = len(sa)
    a, b = sa[:-1].copy(), sa[1:].copy()
    acc = np.zeros(n - 1, dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        step, rank = 1 << j, levels[j]
        ok = (a + acc + step <= n) & (b + acc + step <= n)
        ia, ib = np.minimum(a + acc, n - 1), np.minimum(b + acc, n - 1)
        ok &= rank[ia] == rank[ib]
        acc += np.where(ok, step, 0)
    return np.r_[0, acc]


def _child_ranges(lcp: np.ndarray) -> np.ndarray:
    """(child lb, child rb, interval lb, interval rb, depth) of every child but the largest of each interval."""
    n = len(lcp)
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[list] = [[0, 0, []]]  # depth, lb, l-indices
    values = lcp.tolist() + [-1]
    for k in range(1, n + 1):
        depth, lb = values[k], k - 1
        while stack and depth < stack[-1][0]:
            top_depth, top_lb, marks = stack.pop()
            lb = top_lb
            if top_depth > 0:
                bounds = [top_lb, *marks, k]
                sizes = [bounds[i + 1] - bounds[i] for i in range(len(bounds) - 1)]
                largest = sizes.index(max(sizes))
                out += [(bounds[i], bounds[i + 1] - 1, top_lb, k - 1, top_depth)
                        for i in range(len(sizes)) if i != largest]
        if k == n:
            break
        if depth > stack[-1][0]:
            stack.append([depth, lb, []])
        if depth == stack[-1][0]:
            stack[-1][2].append(k)
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def branching_squares(ids: np.ndarray) -> np.ndarray:
    """(start, period) of every branching square (uu, the word after it breaks the period), sorted, unique."""
    n = len(ids)
    if n < 2:
        return np.zeros((0, 2), dtype=np.int64)
    sa, levels = suffix_array(ids)
    isa = np.empty(n, dtype=np.int64)
    isa[sa] = np.arange(n)
    kids = _child_ranges(lcp_array(sa, levels))
    if not len(kids):
        return np.zeros((0, 2), dtype=np.int64)
    sizes = kids[:, 1] - kids[:, 0] + 1
    owner = np.repeat(np.arange(len(kids)), sizes)
    ks = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + kids[owner, 0]
    i, lb, rb, d = sa[ks], kids[owner, 2], kids[owner, 3], kids[owner, 4]
    found = []
    for start in (i, i - d):  # i opens the square, or i is its second half
        ok = (start >= 0) & (start + 2 * d <= n)
        s0, d0, lo, hi = start[ok], d[ok], lb[ok], rb[ok]
        first, second, end = isa[s0], isa[s0 + d0], s0 + 2 * d0
        breaks = (end == n) | (ids[s0 + d0] != ids[np.minimum(end, n - 1)])
        keep = (first >= lo) & (first <= hi) & (second >= lo) & (second <= hi) & breaks
        found.append(np.stack([s0[keep], d0[keep]], axis=1))
    squares = np.concatenate(found)
    return np.unique(squares, axis=0) if len(squares) else squares.reshape(0, 2)


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < min_length or not _repeats_a_shingle(ids, min(SHINGLE, min_length // 2)):
        return []
    out = []
    for start, period in branching_squares(ids).tolist():
        root = ids[start:start + period]
        if any(period % d == 0 and np.array_equal(root[d:], root[:-d]) for d in range(1, period // 2 + 1)):
            continue  # a power: its stretch has a smaller period
        broken = np.flatnonzero(ids[:start] != ids[period:period + start])
        first = int(broken[-1]) + 1 if len(broken) else 0
        length = start + 2 * period - first
        if length >= max(min_length, 2 * period):
            out.append((first, length, period))
    return sorted(out)


def _repeats_a_shingle(ids: np.ndarray, k: int) -> bool:
    """Whether some k consecutive words occur twice (hashes; a collision only costs a search)."""
    if k < 1 or len(ids) <= k:
        return len(ids) > k
    h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[j:len(ids) - k + 1 + j].astype(np.uint64) + np.uint64(1))
    return len(np.unique(h)) < len(h)


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    gone = np.cumsum(drop)[:len(words)] > 0
    return " ".join(w for w, g in zip(words, gone) if not g)


def _batches(batches: Iterator[pd.DataFrame], key_col: str, text_col: str, runs_col: str, out_col: str
             ) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, collapsed = [], []
        for h, text in zip(batch[key_col].tolist(), batch[text_col].tolist()):
            words = damaged_words(None if h is None or h != h else int(h), split_words(text))
            index: dict[str, int] = {}
            ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
            runs = runs_of(ids)
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            collapsed.append(collapse(words, runs))
        yield batch.assign(**{runs_col: found, out_col: collapsed})


def periodic_runs(docs: DataFrame, text_col: str = "text", damage_key: Column | None = None) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period; by start, then period) and ``collapsed``.

    ``damage_key``, an unsigned 32-bit hash per row (the query's crc32 of the decimal id), turns on the
    contract's damage of the words before the search; null keys leave a row undamaged.
    """
    small_batches(docs.sparkSession)
    runs_col, out_col, key_col = fresh("runs_", docs), fresh("collapsed_", docs), fresh("damage_", docs)
    keyed = docs.withColumn(key_col, F.lit(None).cast("long") if damage_key is None else damage_key.cast("long"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields] +
                       [f"`{runs_col}` array<{RUN}>", f"`{out_col}` string"])
    found = keyed.mapInPandas(lambda b: _batches(b, key_col, text_col, runs_col, out_col), schema)
    kept = [c for c in docs.columns if c.lower() not in {"runs", "collapsed"}]
    return found.select(*kept, F.col(runs_col).alias("runs"), F.col(out_col).alias("collapsed"))
