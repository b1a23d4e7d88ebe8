"""Scores of documents by prediction by partial matching over bytes.

The model is the trie of byte contexts up to ``ORDER`` = 5, as counts of (context, next byte), over the
lower-cased (A-Z) bytes of the training texts; byte 255, which no text has, stands before and after each
text. At a context with total T and d different next bytes a seen byte has n / (T + d), the escape to the
next shorter context d / (T + d) (method C). With symbol exclusion the bytes seen in the longer context are
taken out of T and d of the shorter one. Below the empty context the bytes left are equally likely.

The counts of all orders follow from the longest by dropping the first byte, and what an escape leads to
depends on the context it leaves alone; so the code length of each (context, byte) that the corpus has is
a chain of joins, one order on top of the last. These tables hold one row per different context, and their
joins are sharded by it.

Scoring looks each byte up. The ``TOP`` commonest (context, byte) go to the tasks - the bound is a
parameter, whatever the corpus - and the others are joined: one path for any size. The same holds for
words of the base score, the add-one unigram probability.

Defined cases: a null or empty text is one end token; a null id learns and is not held out; with no
training text every byte has probability 1/256; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.llm.bytesops import LOWER, SPACED_BYTES, HashTable, Tally, slices, span_hashes, split_words, sum_by
from presswatch.session import staged

ORDER = 5
TOP = 1 << 20
END = 255
_GRAM, _WORD = 0, 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts and their ends with its context, packed, and the first of each text."""
    sizes = np.diff(offsets)
    padded = np.full(len(data) + (ORDER + 1) * len(sizes), END, dtype=np.uint64)
    shift = (ORDER + 1) * np.arange(len(sizes)) + ORDER
    padded[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    n = max(0, len(padded) - ORDER)
    packed = padded[:n].copy()
    for i in range(1, ORDER + 1):
        packed = packed << np.uint64(8) | padded[i:n + i]
    begin = offsets[:-1] + (ORDER + 1) * np.arange(len(sizes))
    inside = np.zeros(len(padded) + 1, dtype=np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + sizes + 1, -1)
    return packed[np.cumsum(inside)[:n] == 1], offsets + np.arange(len(offsets))


def gathered(docs: DataFrame) -> DataFrame:
    """(kind, key, n, seen): counts in the training texts, and in all, of grams and words; from (held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {(kind, held): Tally() for kind in (_GRAM, _WORD) for held in (False, True)}

        def out(end: bool) -> Iterator[pa.RecordBatch]:
            for (kind, held), tally in tallies.items():
                if (full := tally.take(end)) is not None:
                    keys, counts = full
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                        pa.array(counts * (not held)), pa.array(counts)], names=["kind", "key", "n", "seen"])

        for batch in batches:
            held_out = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for low, high, data, offsets in slices(batch.column(1)):
                lower, held = LOWER[data], held_out[low:high]
                packed, first = grams(lower, offsets)
                of = np.repeat(held, np.diff(first))
                starts, ends, first = split_words(lower, offsets, SPACED_BYTES)
                words, of_word = span_hashes(lower, starts, ends), np.repeat(held, np.diff(first))
                for part in (False, True):
                    tallies[_GRAM, part].add(packed[of == part])
                    tallies[_WORD, part].add(words[of_word == part])
                yield from out(end=False)
        yield from out(end=True)

    rows = docs.select("held_out", "text").mapInArrow(run, "kind int, key long, n long, seen long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def code_lengths(counts: DataFrame) -> DataFrame:
    """(key, seen, lp): log10 of the probability of each byte after its context, from (key, n, seen)."""
    below = None
    levels, wanted = {ORDER: counts.filter("n > 0").select("key", "n")}, {ORDER: counts.select("key")}
    for order in range(ORDER - 1, -1, -1):
        key = F.col("key").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1)).alias("key")
        levels[order] = staged(levels[order + 1].groupBy(key).agg(F.sum("n").alias("n")), f"counts-{order}")
        wanted[order] = wanted[order + 1].select(key).distinct()
    for order in range(ORDER + 1):
        level = levels[order]
        context = F.shiftright("key", 8).alias("context")
        stats = level.select(context, "n")
        sums = [F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")]
        if order:
            short = F.col("key").bitwiseAND(F.lit((1 << 8 * order) - 1))
            lower = levels[order - 1].select(F.col("key").alias("short"), F.col("n").alias("n_short"))
            stats = level.withColumn("short", short).join(lower, "short").select(context, "n", "n_short")
            sums.append(F.sum("n_short").alias("out"))  # what the bytes seen here have in the shorter context
        stats = stats.groupBy("context").agg(*sums)
        table = (wanted[order].join(level, "key", "left").withColumn("context", F.shiftright("key", 8))
                 .join(stats, "context", "left").na.fill(0, ["n", "total", "kinds", *(["out"] if order else [])]))
        if not order:
            # All bytes of the empty context are out; the others share what is left.
            table = table.withColumn("escaped", -F.log10(F.greatest(F.lit(1), 256 - F.col("kinds"))))
        else:
            table = table.withColumn("short", short).join(below, "short")
            left_kinds = F.col("kinds_short") - F.col("kinds")
            whole = F.col("total_short") - F.col("out") + left_kinds
            table = table.withColumn("escaped", F.when(
                F.col("n_short") > 0, F.log10(F.col("n_short") / F.greatest(whole, F.lit(1)))).otherwise(
                F.when(left_kinds > 0, F.log10(left_kinds / F.greatest(whole, F.lit(1)))).otherwise(0.0)
                + F.col("escaped_short")))
        names = ["key", "n", "total", "kinds", "escaped"]
        table = staged(table.select(*names), f"codes-{order}")
        below = table.select(F.col("key").alias("short"), *[F.col(c).alias(f"{c}_short") for c in names[1:]])
    whole = F.col("total") + F.col("kinds")
    lp = F.when(F.col("n") > 0, F.log10(F.col("n") / F.greatest(whole, F.lit(1)))).otherwise(
        F.when(F.col("kinds") > 0, F.log10(F.col("kinds") / F.greatest(whole, F.lit(1)))).otherwise(0.0)
        + F.col("escaped"))
    return table.select("key", lp.alias("lp")).join(counts.select("key", "seen"), "key").select("key", "seen", "lp")


def commonest(table: DataFrame, value: str, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the ``top`` rows seen most: the bound of what is sent to the tasks."""
    rows = table.orderBy(F.desc("seen"), "key").limit(top).select("key", value).toArrow()
    return rows.column("key").to_numpy().view(np.uint64), rows.column(value).to_numpy()


def _first_pass(docs: DataFrame, codes: tuple[np.ndarray, np.ndarray],
                words: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Sums over what the tasks know, and the other keys of each document as lists."""
    sent = docs.sparkSession.sparkContext.broadcast((codes, words))
    kept = docs.select("row", "doc_id", "held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_table, word_table = (HashTable(*x) for x in sent.value)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(3)):
                lower = LOWER[data]
                packed, first = grams(lower, offsets)
                lp, known = code_table.look_up(packed)
                starts, ends, first_word = split_words(lower, offsets, SPACED_BYTES)
                hashes = span_hashes(lower, starts, ends)
                n, known_word = word_table.look_up(hashes)

                def others(keys: np.ndarray, known: np.ndarray, first: np.ndarray) -> pa.Array:
                    ends = np.concatenate([[0], np.cumsum(~known)])[first].astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[~known].view(np.int64)))

                yield pa.RecordBatch.from_arrays([
                    *(c.slice(low, high - low) for c in batch.columns[:3]), pa.array(np.diff(first_word)),
                    pa.array(sum_by(first_word, (known_word & (n > 0)).astype(np.int64))),
                    pa.array(sum_by(first_word, np.log10(n + 1.0) * known_word)), pa.array(sum_by(first, lp * known)),
                    others(packed, known, first), others(hashes, known_word, first_word)], names=names)

    more = "n_words long, n_known long, base double, lp double, codes array<long>, words array<long>"
    schema = kept.schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", " + more
    names = ["row", "doc_id", "held_out", *(c.split(" ")[0] for c in more.split(", "))]
    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, schema)


def scored(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """One row per document: its id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a condition on a document; the texts for which it does not hold train the model.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    counts = staged(gathered(base), "ppm-counts")
    codes = staged(code_lengths(counts.filter(F.col("kind") == _GRAM).drop("kind")), "ppm-codes")
    words = counts.filter(F.col("kind") == _WORD)
    n_words, kinds = words.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_texts = base.filter("NOT held_out").count()
    total, different = n_words + n_texts, kinds + (n_texts > 0)
    part = staged(_first_pass(base, commonest(codes, "lp", top), commonest(words, "n", top)), "ppm-parts")

    def rest(column: str, table: DataFrame, *sums) -> DataFrame:
        keys = part.filter(F.size(column) > 0).select("row", F.explode(column).alias("key"))
        return keys.join(table, "key").groupBy("row").agg(*sums)

    more_codes = rest("codes", codes.select("key", F.col("lp").alias("more")), F.sum("more").alias("more_lp"))
    more_words = rest("words", words.filter("n > 0").select("key", "n"), F.count(F.lit(1)).alias("more_known"),
                      F.sum(F.log10(F.col("n") + 1.0)).alias("more_base"))
    joined = part.drop("codes", "words").join(more_codes, "row", "left").join(more_words, "row", "left").na.fill(
        0, ["more_lp", "more_known", "more_base"])
    end = float(np.log10(n_texts + 1.0))
    n_tokens = F.col("n_words") + 1
    return joined.select(
        F.col("doc_id").alias(doc_id), "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.col("more_known") + int(n_texts > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base") + end - n_tokens * float(np.log10(total + different + 1.0))).alias("base_score"),
        (F.col("lp") + F.col("more_lp")).alias("score"))
