"""Line deduplication by an exact set-similarity join.

A line is the set of its words (runs of letters, digits and non-ASCII characters, A-Z lower-cased); lines
of fewer than ``min_words`` different words are left alone. A line goes if an earlier line - by (document
id, hash of the text, line number) - has a Jaccard similarity of ``similarity`` or more, whether that one stays
or not. Equal sets are one set, placed where it first stands.

1. Rarity: every word's number of lines is counted over the whole corpus. The ``FREQUENT`` commonest words
   rank by it, all others before them by hash: one order for all tasks, and the result does not depend on it.
2. Prefix filter on neighbours: in that order, a word that only one of two sets has breaks at most two pairs
   of neighbours in it and one in the other. So two similar sets share a pair of neighbours among the first
   2 (1 - t) n + 1 of each; the pair is far rarer than one word of it. Pairs with a word of one line alone,
   then pairs (and digests of whole lines) that occur once in the corpus, are left out in the tasks: bitmaps of
   fixed size (two bits a pair) let wrong ones through and never lose one. Lines with more words of their own than a
   similar line may have are left out, too. Most lines of a corpus end here.
3. Join on the pairs with the length filter (m >= t n), the positional filter and a parity filter: each word
   flips one of 64 bits, and two sets whose maps differ in more bits than similar sets may differ in words
   are no match. First each set meets only the earliest set of each of its pairs; what that removes needs no
   other match, so a group of n near copies costs n comparisons. Then the sets still left meet all earlier ones.
4. Candidates are verified on the whole word sets.

Defined cases: null, empty and wordless texts and lines stay; a null id comes first; rows with equal id and
text are one document; other columns are untouched. A document whose lines all go keeps an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswatch.llm.bytesops import (
    LOWER,
    WORD_BYTES,
    Tally,
    mix,
    slices,
    span_hashes,
    split_words,
    sum_by,
    sum_spans,
)
from presswatch.llm.common import bitmap_of, fresh
from presswatch.session import released, staged

SIMILARITY = 0.8
MIN_WORDS = 3
FREQUENT = (1 << 16) - 1
BITMAP_BITS = 26
KEY_BITS = 27
ROUNDS = 4  # of a join on pairs: the shuffle files of one round go before the next


def _stable(small: np.ndarray, bound: int) -> np.ndarray:
    """The stable order of numbers below ``bound``: numpy sorts 16-bit ones by radix, several times as fast."""
    return np.argsort(small.astype(np.uint16) if bound <= 1 << 16 else small, kind="stable")


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each line, and the first line of each text."""
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    begins[1:][data == 10] = True
    begins[len(data)] = False
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of each line, first line of each text, and the different words of the lines: (line, word), sorted."""
    starts, first = line_starts(data, offsets)
    lower = LOWER[data]
    w_start, w_end, _ = split_words(lower, offsets, WORD_BYTES)
    words = span_hashes(lower, w_start, w_end)
    line = np.searchsorted(starts, w_start, "right") - 1
    order = np.argsort(words)  # equal words of a line are one, in any order
    order = order[_stable(line[order], len(starts))]
    line, words = line[order], words[order]
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
    return starts, first, line[new], words[new]


def needed(n: np.ndarray | int, similarity: float):
    """The least overlap of a set of ``n`` words with a similar one: ceil(t n)."""
    return np.ceil(np.asarray(n) * similarity - 1e-9).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): in how many lines each word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                tally.add(line_sets(data, offsets)[3])
                if (full := tally.take()) is not None:
                    yield out(full)
        if (full := tally.take(end=True)) is not None:
            yield out(full)

    def out(full: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(full[0].view(np.int64)), pa.array(full[1])], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _xor_runs(bits: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(bits) + 1, dtype=np.uint64)
    np.bitwise_xor.accumulate(bits, out=sums[1:])
    return sums[high] ^ sums[low]


def described(docs: DataFrame, frequent: np.ndarray, shared: np.ndarray, repeated: np.ndarray | None,
              similarity: float, min_words: int, bits: int = BITMAP_BITS) -> DataFrame:
    """One row per line of enough words: place, set digest, size, parity map, and prefix pairs with positions.

    ``frequent`` are the commonest words, from the least common on; ``shared`` is the bitmap of the words
    of two lines or more, ``repeated`` that of digests and pairs seen twice: lines with neither are left out.
    Without ``repeated`` the result is (key, n): how often each digest and pair stands in a task's lines. A set
    of so few words that none but itself is similar has no pairs.
    """
    full = StructType([docs.schema["doc_id"], docs.schema["draw"], *StructType.fromDDL(
        "line int, h1 long, h2 long, n int, parity long, prefix array<struct<pair: long, at: int>>").fields])
    by_word = np.argsort(frequent, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast(
        (frequent[by_word], by_word.astype(np.int64) + 1, shared, repeated))

    def held(cells: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
        bit = keys & np.uint64((1 << bits) - 1)
        return (cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) == 1

    def parts(data: np.ndarray, offsets: np.ndarray):
        """Lines of enough words with digest and bounds, and the pairs: line, key, position."""
        known, ranks, cells, _ = sent.value
        starts, first, line, words = line_sets(data, offsets)
        begin = np.searchsorted(line, np.arange(len(starts) + 1))
        n = np.diff(begin)
        take = np.flatnonzero(n >= min_words)
        rank = np.zeros(len(words), dtype=np.int64)
        if len(known) and len(words):
            near = np.minimum(np.searchsorted(known, words), len(known) - 1)
            rank = np.where(known[near] == words, ranks[near], 0)
        order = _stable(rank, len(known) + 1)  # within a line the words are sorted already
        rarest_first = words[order[_stable(line[order], len(starts))]]
        at = np.arange(len(words)) - begin[line] + 1
        size, twice = n[line], held(cells, rarest_first, bits)
        # A similar set has all but (1 - t) n of the words, so no more than these may stand in one line alone.
        alone = sum_by(begin, (~twice).astype(np.int64))
        possible = (alone <= np.floor((1 - similarity) * n + 1e-9))[line]
        pair = mix(rarest_first[:-1] * np.uint64(0x9E3779B97F4A7C15) + rarest_first[1:])
        kept = possible[:-1] & twice[:-1] & twice[1:] & (line[:-1] == line[1:]) if len(words) else np.zeros(0, bool)
        size, at, of = size[:-1], at[:-1], line[:-1]
        kept &= (at <= np.floor(2 * (1 - similarity) * size + 1e-9) + 1) & (size >= min_words)
        kept &= size / (size + 1) >= similarity - 1e-9
        return first, words, begin, n, take, of[kept], pair[kept], at[kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(2)):
                _, words, begin, _, take, _, pair, _ = parts(data, offsets)
                tally.add(np.concatenate([sum_spans(words, begin[take], begin[take + 1]), pair]))
                if (some := tally.take()) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(some[0].view(np.int64)), pa.array(some[1])], names=["key", "n"])
        if (some := tally.take(end=True)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(some[0].view(np.int64)), pa.array(some[1])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value[3]

        def again(keys: np.ndarray) -> np.ndarray:
            return held(cells, keys, KEY_BITS) & held(cells, keys >> np.uint64(64 - KEY_BITS), KEY_BITS)

        for batch in batches:
            for low, high, data, offsets in slices(batch.column(2)):
                first, words, begin, n, take, of, pair, at = parts(data, offsets)
                found = again(pair)
                of, pair, at = of[found], pair[found], at[found]
                h1 = sum_spans(words, begin[take], begin[take + 1])
                ends = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
                wanted = again(h1) | (np.diff(ends)[take] > 0)
                take, h1 = take[wanted], h1[wanted]
                left, right = begin[take], begin[take + 1]
                parity = _xor_runs(np.uint64(1) << (words >> np.uint64(58)), left, right)
                prefix = pa.StructArray.from_arrays(
                    [pa.array(pair.view(np.int64)), pa.array(at.astype(np.int32))], names=["pair", "at"])
                doc = np.searchsorted(first, take, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(low, high - low).take(pa.array(doc)) for c in batch.columns[:2]),
                    pa.array((take - first[doc]).astype(np.int32)), pa.array(h1.view(np.int64)),
                    pa.array(sum_spans(mix(words), left, right).view(np.int64)), pa.array(n[take].astype(np.int32)),
                    pa.array(parity.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), prefix).take(pa.array(take))], names=full.names)

    picked = docs.select("doc_id", "draw", "text")
    return picked.mapInArrow(count, "key long, n long") if repeated is None else picked.mapInArrow(run, full)


def _place_keys(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) + (line.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def place_bitmap(sets: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of where the sets first stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _place_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    rows = sets.select(F.xxhash64("place.doc_id", "place.draw").alias("doc"), "place.line")
    return bitmap_of(rows.mapInArrow(run, "key long"), "key", bits)


def word_sets(texts: DataFrame, wanted: np.ndarray, min_words: int, bits: int = BITMAP_BITS) -> DataFrame:
    """(h1, h2, words): the different words, sorted and packed, of lines whose place is in the bitmap.

    Only these lines are split into words.
    """
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1).to_numpy()
            for low, high, data, offsets in slices(batch.column(0)):
                starts, first = line_starts(data, offsets)
                doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
                cell = _place_keys(docs[low:high][doc], np.arange(len(starts)) - first[doc]) & np.uint64((1 << bits) - 1)
                found = (sent.value[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)) == 1
                size = np.diff(np.append(starts, len(data)))
                data, size = data[np.repeat(found, size)], size[found]
                # Each of these lines is a text here, with its newline if it has one.
                _, _, line, words = line_sets(data, np.append(0, np.cumsum(size)).astype(np.int64))
                begin = np.searchsorted(line, np.arange(len(size) + 1))
                take = np.flatnonzero(np.diff(begin) >= min_words)
                h1 = sum_spans(words, begin[take], begin[take + 1])
                h2 = sum_spans(mix(words), begin[take], begin[take + 1])
                packed = [words[a:b].tobytes() for a, b in zip(begin[take], begin[take + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                                                  pa.array(packed, pa.binary())], names=["h1", "h2", "words"])

    return (texts.select("text", F.xxhash64("doc_id", "draw").alias("doc"))
            .mapInArrow(run, "h1 long, h2 long, words binary")
            .groupBy("h1", "h2").agg(F.first("words").alias("words")))


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """The ids of the sets (x) with a staged pair (x, y) whose exact Jaccard similarity is enough."""
    ids = pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()
    named = staged(sets.select("id", "h1", "h2", "place").join(ids, "id"), "paired-sets")
    full = staged(word_sets(texts, place_bitmap(named), min_words).join(named, ["h1", "h2"])
                  .select("id", "words"), "line-words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["x"]).filter(pa.array(near, pa.bool_()))

    left, right = full.select(F.col("id").alias("x"), F.col("words").alias("a")), full.select(
        F.col("id").alias("y"), F.col("words").alias("b"))
    out = staged(pairs.join(left, "x").join(right, "y").select("x", "a", "b").mapInArrow(run, "x long").distinct(),
                 "similar-lines")
    released(pairs, named, full)
    return out


def similar_sets(sets: DataFrame, texts: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """(x): the sets with a similar set of lower id; ids follow the order of the places."""
    def postings_of(some: DataFrame) -> DataFrame:
        return some.select("id", "n", "parity", F.explode("prefix").alias("p")).select("id", "n", "parity", "p.pair", "p.at")

    def named(some: DataFrame, side: str) -> DataFrame:
        return some.select("pair", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "at", "parity")])

    postings = postings_of(sets)
    size_class = F.floor(F.log("n") / (1.001 * float(-np.log(similarity)))).cast("int")
    overlap = F.ceil((F.col("x_n") + F.col("y_n")) * (similarity / (1 + similarity)) - 1e-9)
    close = ((F.col("y_id") < F.col("x_id"))
             & (F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * similarity - 1e-9)
             & (F.least("x_at", "y_at") + F.least(F.expr("x_n - x_at"), F.expr("y_n - y_at")) >= overlap)
             & (F.bit_count(F.col("x_parity").bitwiseXOR(F.col("y_parity")))
                <= F.col("x_n") + F.col("y_n") - 2 * overlap))
    earliest = (postings.groupBy("pair", size_class.alias("y_class"))
                .agg(F.min(F.struct("id", "n", "at", "parity")).alias("y"))
                .select("pair", "y_class", *[F.col(f"y.{c}").alias(f"y_{c}") for c in ("id", "n", "at", "parity")]))
    x_class = F.floor(F.log("x_n") / (1.001 * float(-np.log(similarity)))).cast("int")

    def candidates(xs: DataFrame, ys: DataFrame, condition: Column) -> DataFrame:
        rounds = []
        for k in range(ROUNDS):
            turn = F.pmod("pair", F.lit(ROUNDS)) == k
            found = xs.filter(turn).join(ys.filter(turn), "pair").filter(condition)
            rounds.append(staged(found.select(F.col("x_id").alias("x"), F.col("y_id").alias("y")).distinct(), "line-round"))
        pairs = staged(reduce(DataFrame.union, rounds).distinct(), "line-pairs")
        released(*rounds)
        return pairs

    stars = candidates(named(postings, "x"), earliest, (F.abs(F.col("y_class") - x_class) <= 1) & close)
    gone = verified(stars, sets, texts, similarity, min_words)
    left = sets.join(gone.select(F.col("x").alias("id")), "id", "left_anti")
    rest = candidates(named(postings_of(left), "x"), named(postings, "y"), close)
    return gone.union(verified(rest, sets, texts, similarity, min_words))


def later_lines(docs: DataFrame, doc_id: str, text: str, similarity: float, min_words: int) -> DataFrame:
    """(doc_id, draw, lines): the numbers of the lines to remove from each text that has some."""
    if not 0.5 <= similarity <= 1:
        raise ValueError("the prefix of neighbours needs a similarity of 0.5 or more")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("draw"), F.col(text).alias("text"))
    counts = staged(word_counts(base).filter("n > 1"), "line-word-counts")
    common = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").toArrow()
    frequent = common.column("word").to_numpy().view(np.uint64)[::-1]
    shared = bitmap_of(counts, "word", BITMAP_BITS)
    released(counts)
    keys = described(base, frequent, shared, None, similarity, min_words).groupBy("key").agg(F.sum("n").alias("n"))
    keys = staged(keys.filter("n > 1").select("key"), "line-keys")
    both = keys.select(F.explode(F.array("key", F.shiftrightunsigned("key", 64 - KEY_BITS))).alias("key"))
    repeated = bitmap_of(both, "key", KEY_BITS)
    released(keys)
    lines = staged(described(base, frequent, shared, repeated, similarity, min_words), "lines")
    place = F.struct("doc_id", "draw", "line")
    grouped = lines.groupBy("h1", "h2").agg(
        F.min(place).alias("place"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("parity").alias("parity"), F.first("prefix").alias("prefix"))
    order = [F.col("place.doc_id").asc_nulls_first(), F.col("place.draw"), F.col("place.line")]
    sets = staged(grouped.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("id", F.monotonically_increasing_id()), "line-sets")
    similar = similar_sets(sets, base, similarity, min_words).select(F.col("x").alias("id"), F.lit(True).alias("similar"))
    touched = sets.select("id", "h1", "h2", F.col("place").alias("kept"), "copies").join(similar, "id", "left").filter(
        "similar OR copies > 1")
    out = (lines.select("h1", "h2", "doc_id", "draw", "line").join(touched, ["h1", "h2"])
           .filter(F.col("similar").isNotNull() | ~place.eqNullSafe(F.col("kept"))))
    found = staged(out.groupBy("doc_id", "draw").agg(F.array_sort(F.collect_set("line")).alias("lines")), "cut-lines")
    released(lines, sets, similar)
    return found


def without_similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str | None = None,
                          similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines cut out of ``text`` that have a similar earlier line.

    With ``removed``, a column of that name holds the numbers (from 0) of the lines cut.
    """
    key, other, cut = fresh("draw", docs), fresh("other_id", docs), removed or fresh("removed_lines", docs)
    found = later_lines(docs, doc_id, text, similarity, min_words).select(
        F.col("doc_id").alias(other), F.col("draw").alias(key), F.col("lines").alias(cut))
    names = [c for c in docs.columns if c != cut]
    base = docs.select(*names).withColumn(key, F.xxhash64(F.col(text)))
    joined = base.join(found, (base[key] == found[key]) & base[doc_id].eqNullSafe(found[other]), "left").select(
        *[base[c] for c in names], F.coalesce(found[cut], F.array().cast("array<int>")).alias(cut))
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col(cut), i)), "\n")
    cleaned = joined.withColumn(text, F.when(F.size(cut) > 0, kept).otherwise(F.col(text)))
    return cleaned if removed else cleaned.select(*docs.columns)
