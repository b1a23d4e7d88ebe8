"""Substring deduplication by hashing units of text.

A unit is a sentence of a line (it ends at ``.``, ``!`` or ``?`` before white space, or with the line), with
the white space after it, so that the units of a text joined are the text. Normal form: its words (runs of
letters, digits and non-ASCII characters, A-Z lower-cased); a sentence of fewer than ``min_words`` words is
left alone. Digests have 128 bits. With ``lines``, whole lines of one word or more are units too and come
first: a later copy of a line is removed, and sentences are compared within the lines left. A paragraph that
repeats goes with its lines.

1. Half digests are counted over the whole corpus, combined in each task first. Those seen twice fill a
   bitmap of fixed size, which lets wrong ones through and never loses one.
2. Only units that pass it are grouped by the whole digest; the earliest by (document id, text digest,
   place) is kept, all others are removed. No group is ever gathered: each is a minimum.
3. The places to remove return to their documents, which cut them out; offsets are those of the original
   text in code points.

Defined cases: null and empty texts have no units and stay; rows with equal id and text are one document;
a null id ranks first; a line without words stays; without ``lines``, a text that repeats as a whole keeps
its short units; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswatch.llm.bytesops import LOWER, WORD_BYTES, mix, slices, span_hashes, split_words, sum_spans
from presswatch.llm.common import bitmap_of, fresh
from presswatch.session import staged

MIN_WORDS = 6
BITMAP_BITS = 26
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def units(data: np.ndarray, offsets: np.ndarray, whole_lines: bool = False) -> tuple[
        np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of each unit, first unit of each text, words of each unit, and its digest in two halves."""
    n = len(data)
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    begins[1:][data == 10] = True
    if not whole_lines:
        space = _SPACE[data]
        # A sentence ends at a stop before white space; the next begins at the next byte that is none.
        gap_start = np.flatnonzero(space & np.r_[False, _STOP[data[:-1]]] if n else space)
        solid = np.flatnonzero(~space)
        after = np.searchsorted(solid, gap_start)
        begins[solid[after[after < len(solid)]]] = True
    begins[n] = False
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    lower = LOWER[data]
    w_start, w_end, _ = split_words(lower, offsets, WORD_BYTES)
    words = span_hashes(lower, w_start, w_end)
    low = np.searchsorted(w_start, starts)
    high = np.append(low[1:], len(w_start)) if len(low) else low
    h1, h2 = sum_spans(words, low, high), sum_spans(mix(words), low, high)
    return starts, first, high - low, mix(h1 + np.uint64(1)) if whole_lines else h1, h2


def _unit_rows(docs: DataFrame, cells: np.ndarray | None, min_words: int, bits: int, lines: bool) -> DataFrame:
    """Units of enough words: half digests alone, or, behind the bitmap, (doc_id, text_key, unit, line, h1, h2).

    ``unit`` is the number of a sentence in its text, -1 for a whole line; ``line`` is that of the line.
    """
    ids = [f for f in docs.schema.fields if f.name != "text"]
    more = "h1 long" if cells is None else "unit int, line int, h1 long, h2 long"
    schema = StructType([*([] if cells is None else ids), *StructType.fromDDL(more).fields])
    shared = None if cells is None else docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(batch.num_columns - 1)):
                line_starts = None
                for whole in ([True, False] if lines else [False]):
                    starts, first, n_words, h1, h2 = units(data, offsets, whole)
                    if whole:
                        line_starts, line_first = starts, first
                    take = np.flatnonzero(n_words >= (1 if whole else min_words))
                    if shared is not None:
                        bit = h1[take] & np.uint64((1 << bits) - 1)
                        cell = shared.value[(bit >> np.uint64(6)).astype(np.int64)]
                        take = take[(cell >> (bit & np.uint64(63)) & np.uint64(1)) == 1]
                    columns = [pa.array(h1[take].view(np.int64))]
                    if shared is not None:
                        doc = np.searchsorted(first, take, "right") - 1
                        unit, line = take - first[doc], np.zeros(len(take))
                        if lines:
                            line = np.searchsorted(line_starts, starts[take], "right") - 1 - line_first[doc]
                        if whole:
                            unit = np.full(len(take), -1)
                        columns = [*(c.slice(low, high - low).take(pa.array(doc)) for c in batch.columns[:-1]),
                                   pa.array(unit.astype(np.int32)), pa.array(line.astype(np.int32)), *columns,
                                   pa.array(h2[take].view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _later(found: DataFrame) -> DataFrame:
    """The rows of ``found`` that have an earlier one of the same digest, with ``kept``: the first."""
    place = F.struct("doc_id", "text_key", "line", "unit")
    firsts = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).filter("n > 1")
    firsts = staged(firsts, "first-units")  # a join apart from the grouping may split a digest with many copies
    return found.join(firsts, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("kept")))


def later_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                bits: int = BITMAP_BITS, lines: bool = False) -> DataFrame:
    """(doc_id, text_key, drop): for each text with repeats, the units to remove and where the first stands."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("text_key"),
                         F.col(text).alias("text"))
    counted = _unit_rows(picked, None, min_words, bits, lines).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
    seen = staged(counted.filter("n > 1").select("h1"), "repeated-halves")
    found = staged(_unit_rows(picked, bitmap_of(seen, "h1", bits), min_words, bits, lines).distinct(), "repeated-units")
    wanted = ["doc_id", "text_key", "line", "unit", "kept"]
    later = _later(found.filter("unit >= 0")).select(*wanted)
    if lines:
        gone = staged(_later(found.filter("unit < 0")).select(*wanted), "repeated-lines")
        # The first of equal sentences is to stand in a line that stays.
        left = found.filter("unit >= 0").alias("a").join(gone.alias("b"), F.expr(
            "a.doc_id <=> b.doc_id AND a.text_key = b.text_key AND a.line = b.line"), "left_anti")
        later = _later(left).select(*wanted).union(gone)
    return later.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("line", "unit", F.col("kept.doc_id").alias("first_id")))).alias("drop"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                    spans: str | None = None, bits: int = BITMAP_BITS, lines: bool = False) -> DataFrame:
    """``docs`` with each later copy of a unit (with ``lines``, of a whole line first) cut out of ``text``.

    With ``spans``, a column of that name holds (start, end, first_id) of each cut, in code points of the
    original text, and the id of the document that keeps the unit.
    """
    key, drop, spans_as = fresh("text_key", docs), fresh("drop", docs), spans or fresh("spans", docs)
    found = later_units(docs, doc_id, text, min_words, bits, lines)
    found = found.select(F.col("doc_id").alias(fresh("other_id", docs)), F.col("text_key").alias(key),
                         F.col("drop").alias(drop))
    other = found.columns[0]
    base = docs.drop(spans_as).withColumn(key, F.md5(F.col(text))).alias("d")
    joined = base.join(found.alias("f"), (F.col(f"d.`{key}`") == F.col(f"f.`{key}`"))
                       & F.col(f"d.`{doc_id}`").eqNullSafe(F.col(f"f.`{other}`")), "left")
    names = [c for c in docs.columns if c != spans_as]
    wide = joined.select(*[F.col(f"d.`{c}`") for c in names], F.col(f"f.`{drop}`"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    cut = StructType.fromDDL(f"`{spans_as}` array<struct<start: int, end: int, first_id: {id_type}>>").fields[0]
    schema = StructType([*[docs.schema[c] for c in names], cut])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column(at).to_pylist(), []
            drops = batch.column(batch.num_columns - 1).to_pylist()
            for i, (old, dropped) in enumerate(zip(texts, drops, strict=True)):
                cuts.append([])
                if not dropped or old is None:
                    continue
                raw = np.frombuffer(old.encode(), np.uint8)
                starts, line_starts = (units(raw, np.array([0, len(raw)]), whole)[0] for whole in (False, True))
                ends, line_ends = (np.append(x[1:], len(raw)) for x in (starts, line_starts))
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                keep = np.ones(len(raw), dtype=bool)
                for d in dropped:
                    at_line = d["unit"] < 0
                    a, b = (line_starts[d["line"]], line_ends[d["line"]]) if at_line else (starts[d["unit"]], ends[d["unit"]])
                    keep[a:b] = False
                    cuts[-1].append({"start": int(points[a]), "end": int(points[b]), "first_id": d["first_id"]})
                texts[i] = raw[keep].tobytes().decode()
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, columns[at].type)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), (
                "first_id", batch.schema.field(names.index(doc_id)).type)]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts, kind)], names=schema.names)

    out = wide.mapInArrow(run, schema)
    return out if spans else out.select(*names)
