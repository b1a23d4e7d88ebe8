"""Near-duplicate documents by ProbMinHash, banding and an exact check.

A document is its multiset of ``k``-word shingles (words: runs of letters, digits and non-ASCII
characters, A-Z lower-cased; a text of fewer words is one shingle). Similarity is the probability
Jaccard of the two weight vectors, J_P = sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i);
with equal weights it is the Jaccard of the two sets.

1. Signature: each shingle sends points of a Poisson process whose rate is its weight to random
   places of the signature; a place keeps the shingle of its first point. A shingle stops sending as
   soon as its time is past the latest first point, so most send one point. Two documents agree in a
   place with probability J_P.
2. Banding: ``bands`` bands of ``rows`` places; documents that agree in a band share a bucket. With 25
   bands of 5 a pair of similarity 0.8 shares one with probability 0.99995.
3. Links: a bucket compares its members with one pivot, the first in one of ``PIVOTS`` random orders,
   exactly. Members linked so far are one class, so a group of n copies costs a few n comparisons, never all
   pairs. Buckets that still hold several classes meet other pivots, ``TURNS`` in all. Then members of different
   classes are compared with each other, each pair in one bucket, so no candidate link between different
   classes is lost; a parity map and a prefix of the rarest shingles in the join's condition keep out pairs that
   cannot be similar, such as those which share only a common passage. What is left are the links that join
   classes and pairs just below the limit. Comparisons are joins on a member's own id.
4. Classes are the connected components of the links.

Equal texts are one node. Defined cases: a text without words (null, empty) is a class of its own, per
document; a null id never names a class unless all ids of it are null; repeated rows share a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswatch.llm.bytesops import (
    LOWER,
    WORD_BYTES,
    Tally,
    gram_hashes,
    mix,
    slices,
    span_hashes,
    split_words,
    sum_spans,
)
from presswatch.llm.common import fresh
from presswatch.llm.components import components
from presswatch.session import staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
PIVOTS = 4
TURNS = 3
FREQUENT = 1 << 16
PARITY = 1024


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each distinct shingle, ordered by text and hash."""
    lower = LOWER[data]
    starts, ends, first = split_words(lower, offsets, WORD_BYTES)
    words = span_hashes(lower, starts, ends)
    n_words = np.diff(first)
    doc_of = np.repeat(np.arange(len(n_words)), n_words)
    grams = gram_hashes(words, k)
    full = np.arange(len(grams)) + k <= first[1:][doc_of[:len(grams)]] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    doc = np.concatenate([doc_of[:len(grams)][full], short])
    value = np.concatenate([grams[full], sum_spans(words, first[short], first[short + 1])])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """The shingle kept in each place of each text's signature (n_docs x size)."""
    earliest = np.full(n_docs * size, np.inf)
    kept = np.zeros(n_docs * size, dtype=np.uint64)
    latest = np.full(n_docs, np.inf)
    time = np.zeros(len(doc))
    point = 0
    while len(doc):
        point += 1
        draw = mix(value + np.uint64(point * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log1p((draw >> np.uint64(11)) * -(2.0 ** -53)) / weight
        place = doc * size + (mix(draw) % np.uint64(size)).astype(np.int64)
        better = np.flatnonzero(time < earliest[place])
        better = better[np.argsort(-time[better], kind="stable")]  # of equal places the last, earliest, stays
        earliest[place[better]] = time[better]
        kept[place[better]] = value[better]
        touched = np.unique(doc)
        latest[touched] = earliest.reshape(n_docs, size)[touched].max(axis=1)
        going = time < latest[doc]
        doc, value, weight, time = doc[going], value[going], weight[going], time[going]
    return kept.reshape(n_docs, size)


def probability_jaccard(a: np.ndarray, v: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """J_P of two multisets, given as sorted distinct hashes with weights."""
    both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = v[at_a].astype(float), w[at_b].astype(float)
    only_a, only_b = float(v.sum()) - x.sum(), float(w.sum()) - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    # For shared i: the sum over j of max(x_j / x_i, y_j / y_i) takes x_j where x_j / y_j >= x_i / y_i.
    from_ = np.searchsorted(ratio, ratio, "left")
    x_tail = np.append(np.cumsum(x[::-1])[::-1], 0.0)[from_] + only_a
    y_head = np.concatenate([[0.0], np.cumsum(y)])[from_] + only_b
    return float((1.0 / (x_tail / x + y_head / y)).sum())


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, bands): the bucket hash of each band, null for a text without words."""
    schema = StructType([docs.schema["doc_id"], docs.schema["text_key"],
                         *StructType.fromDDL("bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(2)):
                doc, value, weight = shingles(data, offsets, k)
                kept = signatures(doc, value, weight.astype(float), high - low, bands * rows)
                cells = kept.reshape(high - low, bands, rows)
                bucket = np.tile(np.arange(bands, dtype=np.uint64), (high - low, 1))
                for row in range(rows):
                    bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, row])
                empty = np.ones(high - low, dtype=bool)
                empty[doc] = False
                flat = pa.array(bucket.view(np.int64).ravel())
                found = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (high - low + 1) * bands, bands, dtype=np.int32)), flat, mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(low, high - low) for c in batch.columns[:2]), found], names=schema.names)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, grams, weights, n, total, parity): the shingles of a text as packed numbers, how many there are,
    their weight, and a map of ``PARITY`` bits in which each shingle flips one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                doc, value, weight = shingles(data, offsets, k)
                ends = np.searchsorted(doc, np.arange(high - low + 1)).tolist()
                raw, own = value.tobytes(), weight.astype(np.uint32).tobytes()
                flips = np.bincount(doc * PARITY + (value & np.uint64(PARITY - 1)).astype(np.int64),
                                    minlength=(high - low) * PARITY) & 1
                maps = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)
                size = np.arange(0, len(maps) + 1, PARITY // 64, dtype=np.int32)
                pairs = list(zip(ends, ends[1:], strict=False))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array([raw[8 * a:8 * b] for a, b in pairs], pa.binary()),
                    pa.array([own[4 * a:4 * b] for a, b in pairs], pa.binary()), pa.array(np.diff(ends)),
                    pa.array([int(weight[a:b].sum()) for a, b in pairs], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(size), pa.array(maps))],
                    names=["node", "grams", "weights", "n", "total", "parity"])

    return texts.select("node", "text").mapInArrow(
        run, "node long, grams binary, weights binary, n long, total long, parity array<long>")


def may_be_near(similarity: float) -> Column:
    """Whether the parity maps of two sets allow the similarity; it never fails for a pair that has it.

    The maps differ in no more bits than the sets in shingles. With weights of one these are at most
    (1 - s) / (1 + s) of both sizes; else what is not shared has at most 1 - s of each weight.
    """
    differ = sum((F.bit_count(F.get("parity_a", F.lit(i)).bitwiseXOR(F.get("parity_b", F.lit(i))))
                  for i in range(PARITY // 64)), F.lit(0))
    single = (F.col("n_a") == F.col("total_a")) & (F.col("n_b") == F.col("total_b"))
    share = F.when(single, (1 - similarity) / (1 + similarity)).otherwise(1 - similarity)
    return differ <= share * (F.col("total_a") + F.col("total_b")) + 1e-9


def linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches ``similarity``."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"), F.col("weights").alias("wa"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"), F.col("weights").alias("wb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [probability_jaccard(np.frombuffer(r["ga"], np.uint64), np.frombuffer(r["wa"], np.uint32),
                                        np.frombuffer(r["gb"], np.uint64), np.frombuffer(r["wb"], np.uint32))
                    >= similarity - 1e-12 for r in batch.to_pylist()]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "wa", "gb", "wb").mapInArrow(
        run, "a long, b long")


def star_links(members: DataFrame, sets: DataFrame, similarity: float, turn: int = 0) -> DataFrame:
    """The links of the members of each bucket with its pivot, from (bucket, node, comp); those of its class are left out."""
    rank = F.struct(F.xxhash64("node", F.pmod("bucket", F.lit(PIVOTS)), F.lit(turn)).alias("draw"), "node", "comp")
    pivots = members.groupBy("bucket").agg(F.min(rank).alias("pivot"))
    stars = (members.join(pivots, "bucket").filter("comp <> pivot.comp")
             .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct())
    return staged(linked(stars, sets, similarity), "star-links")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, comp): the members of the buckets that hold several classes."""
    named = members.select("bucket", "node").join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("comp", "node").alias("comp"))
    several = (named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
               .filter("low < high").select("bucket"))
    return staged(named.join(several, "bucket"), "open-buckets")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, prefix): the rarest shingles of a set, as 32-bit numbers, of just more than 1 - s of its weight.

    J_P is at most the share of either weight that both sets have, so what stands before the first shared
    shingle has at most 1 - s of it: similar sets share a shingle of both prefixes, in whatever order. The
    ``FREQUENT`` commonest shingles come last, by their number of sets, the others before them by hash.
    """
    picked = sets.select("node", "grams", "weights")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                tally.add(np.frombuffer(b"".join(batch.column(1).slice(low, 256).to_pylist()), np.uint64))
            if (some := tally.take()) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(some[0].view(np.int64)), pa.array(some[1])], names=["gram", "n"])
        if (some := tally.take(end=True)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(some[0].view(np.int64)), pa.array(some[1])], names=["gram", "n"])

    counts = picked.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    common = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").toArrow()
    frequent = common.column("gram").to_numpy().view(np.uint64)[::-1]
    order = np.argsort(frequent, kind="stable")
    sent = sets.sparkSession.sparkContext.broadcast((frequent[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = sent.value
        for batch in batches:
            out = []
            for grams, weights in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                value, weight = np.frombuffer(grams, np.uint64), np.frombuffer(weights, np.uint32).astype(np.int64)
                rank = np.zeros(len(value), dtype=np.int64)
                if len(known):
                    near = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    rank = np.where(known[near] == value, ranks[near], 0)
                rarest_first = np.lexsort((value, rank))
                before = np.cumsum(weight[rarest_first]) - weight[rarest_first]
                taken = rarest_first[before <= (1 - similarity) * weight.sum() + 1e-6]
                out.append((value[taken] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["node", "prefix"])

    return picked.mapInArrow(run, "node long, prefix array<int>")


def cross_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of members of different classes of a bucket that may be similar, each in one of its buckets."""
    own = members.groupBy("node").agg(F.collect_set("bucket").alias("open"))
    wanted = sets.join(own, "node")
    described = staged(wanted.select("node", "n", "total", "parity", "open").join(
        prefixes(wanted, similarity), "node"), "open-sets")
    named = members.join(described, "node")
    one, other = ([F.col(c).alias(f"{c}_{side}") for c in ("node", "comp", "n", "total", "parity", "open", "prefix")]
                  for side in "ab")
    return (named.select("bucket", *one).join(named.select("bucket", *other), "bucket")
            .filter((F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & may_be_near(similarity)
                    & F.arrays_overlap("prefix_a", "prefix_b")
                    & (F.array_min(F.array_intersect("open_a", "open_b")) == F.col("bucket")))
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def node_classes(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], k: int, similarity: float) -> DataFrame:
    """(node, comp) for the nodes with a link, from (node, bands); ``texts_of`` gives (node, text) for given nodes."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = staged(members.join(shared, "bucket"), "bucket-members")
    wanted = members.select("node").distinct()
    sets = staged(shingle_sets(texts_of(wanted), k), "shingle-sets")
    links = star_links(members.withColumn("comp", F.col("node")), sets, similarity)
    labels = components(links)
    members = open_members(members, labels)
    for turn in range(1, TURNS):
        more = star_links(members, sets, similarity, turn)
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components(links)
        members = open_members(members, labels)
    more = staged(linked(cross_pairs(members, sets, similarity), sets, similarity), "cross-links")
    return labels if more.isEmpty() else components(links.union(more))


def classified(docs: DataFrame, doc_id: str, text: str, k: int, similarity: float, bands: int,
               rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, comp) of the documents with words, and (doc_id, text_key) of the others."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    sketch = staged(sketched(base, k, bands, rows), "sketches")
    with_words = sketch.filter("bands IS NOT NULL")
    nodes = staged(with_words.groupBy("text_key").agg(F.first("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()), "distinct-texts")

    def texts_of(wanted: DataFrame) -> DataFrame:
        # Only texts that share a bucket move; the copies of a text are one row per task before they do.
        keys = nodes.select("node", "text_key").join(wanted, "node")
        return (base.select("text_key", "text").join(keys, "text_key").groupBy("node")
                .agg(F.first("text").alias("text")))

    labels = node_classes(nodes.select("node", "bands"), texts_of, k, similarity)
    named = nodes.select("node", "text_key").join(labels, "node", "left").select(
        "text_key", F.coalesce("comp", "node").alias("comp"))
    grouped = with_words.select("doc_id", "text_key").join(named, "text_key").select("doc_id", "text_key", "comp")
    return staged(grouped, "classes"), sketch.filter("bands IS NULL").select("doc_id", "text_key")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
                 similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id``, class_id (least id of the class) and class_size."""
    grouped, alone = classified(docs, doc_id, text, k, similarity, bands, rows)
    classes = grouped.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return grouped.join(classes, "comp").select("doc_id", "class_id", "class_size").union(alone.select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    ).withColumnRenamed("doc_id", doc_id)


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE,
                        similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each class, that of the least id (of equal ids, the least text digest).

    Rows that repeat the id and text of the kept document go too; documents without words all stay.
    """
    grouped, _ = classified(docs, doc_id, text, k, similarity, bands, rows)
    place = F.struct("doc_id", "text_key")
    kept = grouped.groupBy("comp").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = grouped.join(kept, "comp")
    other, key = fresh("other_id", docs), fresh("text_key", docs)
    named = [F.col("doc_id").alias(other), F.col("text_key").alias(key)]
    gone = staged(members.filter(~place.eqNullSafe(F.col("kept"))).select(*named).distinct(), "near-copies")
    again = staged(members.filter(place.eqNullSafe(F.col("kept"))).groupBy("doc_id", "text_key")
                   .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*named), "repeated-rows")
    rows_ = docs.withColumn(key, F.md5(F.col(text)))

    def matched(how: str, keys: DataFrame, frame: DataFrame) -> DataFrame:
        return frame.join(keys, (frame[key] == keys[key]) & frame[doc_id].eqNullSafe(keys[other]), how)

    stay = matched("left_anti", gone, rows_)
    if not again.isEmpty():
        once = matched("left_semi", again, stay).dropDuplicates([doc_id, key])
        stay = matched("left_anti", again, stay).union(once)
    return stay.select(*docs.columns)
