"""Benchmark decontamination by winnowing.

A *window* is ``span`` consecutive words of a benchmark item; an item with fewer words (but some) is
one window. Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.

1. Each text keeps the smallest hash of every run of ``w`` neighbouring k-grams. With
   ``k + w - 1 = span`` each window holds a kept k-gram, and the same one on both sides, so no shared
   window can be missed. Shorter items get a (k, w) of their own for each of their lengths.
2. The kept hashes of the items fill a bitmap of fixed size. A task drops the fingerprints of a
   document that are not in it. The bitmap lets wrong ones through but never loses one; it bounds what
   is sent to the tasks, and any number of items gives the same result.
3. Around each fingerprint left, the windows that contain it are cut out of the document and joined
   with the windows of the items by their text: an exact check. Extended hits are the union of
   matching windows.

Work is keyed by the digest of the text, so copies of a text are checked once and a group of copies
costs one row per task. Defined cases: a null or empty text has no words and no hits; a null item
text has no windows; a null item id counts in ``n_hit`` but not in ``item_ids``; equal item ids are
one item; repeated documents each get their row; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswatch.llm.bytesops import LOWER, WORD_BYTES, gram_hashes, slices, span_hashes, split_words
from presswatch.llm.common import bitmap_of, fresh
from presswatch.session import staged

SPAN = 10
BITMAP_BITS = 24


def parts_of(length: int) -> tuple[int, int]:
    """k and w of the fingerprints that cannot miss ``length`` equal words: k + w - 1 = length."""
    k = (length + 1) // 2
    return k, length - k + 1


def fingerprints(words: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the kept k-grams; ``ends`` has for each word the end of its text."""
    k, w = parts_of(length)
    n = max(0, len(words) - length + 1)
    grams = gram_hashes(words, k, length)
    least, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for shift in range(1, w):
        other = grams[shift:shift + n]
        lower = other <= least
        least[lower] = other[lower]
        at[lower] = shift
    start = np.arange(n)
    places = np.unique((start + at)[start + length <= ends[:n]])
    return grams[places], places


def _words(data: np.ndarray, offsets: np.ndarray):
    lower = LOWER[data]
    starts, ends, first = split_words(lower, offsets, WORD_BYTES)
    hashes = span_hashes(lower, starts, ends)
    return lower, starts, ends, first, hashes, np.repeat(first[1:], np.diff(first))


def _window(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, length: int) -> str:
    return b" ".join(lower[starts[i]:ends[i]].tobytes() for i in range(at, at + length)).decode("utf-8", "replace")


def item_windows(items: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """(item, length, window, fingerprints): one row per item and window, with the item's kept hashes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"item": [], "length": [], "window": [], "fingerprints": []}
            for low, high, data, offsets in slices(batch.column(1)):
                lower, starts, ends, first, hashes, _ = _words(data, offsets)
                for i in range(high - low):
                    begin, end = int(first[i]), int(first[i + 1])
                    if begin == end:
                        continue
                    length = min(span, end - begin)
                    own, _ = fingerprints(hashes[begin:end], np.full(end - begin, end - begin), length)
                    for at in range(begin, end - length + 1):
                        rows["item"].append(batch.column(0)[low + i].as_py())
                        rows["length"].append(length)
                        rows["window"].append(_window(lower, starts, ends, at, length))
                        rows["fingerprints"].append(own.astype(np.int64).tolist() if at == begin else [])
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("item", pa.string()), ("length", pa.int32()), ("window", pa.string()),
                ("fingerprints", pa.list_(pa.int64()))]))

    return items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(
        run, "item string, length int, window string, fingerprints array<long>")


def bitmap(windows: DataFrame, length: int, bits: int = BITMAP_BITS) -> np.ndarray:
    """The fingerprints of the items of one length as a bitmap: at most 2^bits / 64 numbers reach the driver."""
    return bitmap_of(windows.filter(F.col("length") == length).select(F.explode("fingerprints").alias("h")), "h", bits)


def candidate_windows(docs: DataFrame, text: str, keep: Sequence[str], bitmaps: dict[int, np.ndarray],
                      bits: int = BITMAP_BITS) -> DataFrame:
    """``keep`` columns, n_words and the windows of each document that hold a fingerprint of the bitmaps."""
    picked = docs.select(*keep, F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)
    more = StructType.fromDDL("n_words long, windows array<struct<at: int, length: int, window: string>>")
    schema = StructType([*docs.select(*keep).schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        kind = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("window", pa.string())]))
        for batch in batches:
            counts, found = [], []
            for low, high, data, offsets in slices(batch.column(batch.num_columns - 1)):
                lower, starts, ends, first, hashes, text_end = _words(data, offsets)
                counts.append(np.diff(first))
                rows: list[list] = [[] for _ in range(high - low)]
                for length, cells in maps.items():
                    _, w = parts_of(length)
                    kept, places = fingerprints(hashes, text_end, length)
                    bit = kept & np.uint64((1 << bits) - 1)
                    hit = (cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
                    at = {s for p in places[hit == 1].tolist() for s in range(max(0, p - w + 1), p + 1)}
                    own = np.array(sorted(at), dtype=np.int64)
                    doc = np.searchsorted(first, own, "right") - 1
                    for s, d in zip(own.tolist(), doc.tolist(), strict=True):
                        if s + length <= first[d + 1]:
                            rows[d].append({"at": int(s - first[d]), "length": length,
                                            "window": _window(lower, starts, ends, s, length)})
                found += rows
            n_words = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_words), pa.array(found, kind)],
                names=[*batch.schema.names[:-1], "n_words", "windows"])

    return picked.mapInArrow(run, schema)


def _scan(docs: DataFrame, items: DataFrame, text: str, keep: Sequence[str], item_id: str, item_text: str,
          span: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their candidate windows, and the hits per text digest."""
    windows = staged(item_windows(items, item_id, item_text, span), "item-windows")
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``span`` values
    bitmaps = {n: bitmap(windows, n) for n in sorted(lengths)}
    with_key = docs.select(*keep, F.md5(F.col(text)).alias("text_key"), F.col(text).alias("text_of_doc"))
    scanned = staged(candidate_windows(with_key, "text_of_doc", [*keep, "text_key"], bitmaps), "doc-windows")
    found = (scanned.filter(F.size("windows") > 0).select("text_key", F.explode("windows").alias("w"))
             .select("text_key", "w.at", "w.length", "w.window").distinct())
    known = windows.select("length", "window").distinct()
    matched = staged(found.join(known, ["length", "window"], "left_semi"), "matched-windows")
    words = (matched.select("text_key", F.explode(F.expr("sequence(at, at + length - 1)")).alias("word"))
             .distinct().groupBy("text_key").agg(F.count(F.lit(1)).alias("n_hit")))
    owners = windows.select("length", "window", "item").distinct()
    named = (matched.select("text_key", "length", "window").distinct().join(owners, ["length", "window"])
             .groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    return scanned, words.join(named, "text_key")


def hit_texts(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", span: int = SPAN) -> DataFrame:
    """(text_key, n_hit, item_ids) of the texts that hold a window; text_key is the MD5 digest of the text."""
    return _scan(docs, items, text, [], item_id, item_text, span)[1]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: its id, n_words, n_hit, item_ids (array of text), contaminated."""
    scanned, hits = _scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, "text",
                          ["doc_id"], item_id, item_text, span)
    return scanned.select("doc_id", "text_key", "n_words").join(hits, "text_key", "left").select(
        F.col("doc_id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                         item_text: str = "text", span: int = SPAN) -> DataFrame:
    """The documents that hold no window of any item; all columns as they were."""
    key = fresh("text_key", docs)
    hits = hit_texts(docs, items, text, item_id, item_text, span).select(F.col("text_key").alias(key))
    return docs.withColumn(key, F.md5(F.col(text))).join(hits, key, "left_anti").select(*docs.columns)
