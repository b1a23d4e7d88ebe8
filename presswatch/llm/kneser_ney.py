"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

Tokens are runs of letters, digits and non-ASCII characters, and runs of other characters between white
space, as written. Each language has a trigram model of its own, trained on trusted documents:
p3 = a(uvw) + g(uv) (a(vw) + g(v) (a(w) + g / (V + 1))), where a is a discounted share and g the mass the
discounts leave; the lower orders count different contexts, not occurrences, and each order has the three
discounts of modified Kneser-Ney from its counts of counts.

All trusted documents take part: three fifths of a language's train its model, two fifths are held out to
find the ``QUANTILE`` of perplexity; a document beyond it is rejected (``per_language`` and ``chars`` bound
them on request only, in order of a hash of the id; a text that does not fit is passed over). A model of
few characters, ``TOP`` at most, is a table of smoothed rows that all tasks get. Any other is the counts of its
grams, in parts by key (``grams``): units of texts ask the parts for the counts of their grams and smooth them
when the answers come, so no smoothed table is made or joined. All documents are scored whole.

Small languages, with fewer than ``LEAST_HELD_OUT`` held out: their model is of all their trusted texts, and
the perplexities are cross-validated, each text by a model of the other ``FOLDS`` - 1 parts. Where these are
fewer than ``LEAST_HELD_OUT`` too, the limit is the median of them times the quantile, over the texts of all
languages, of perplexity over its language's median; without any, it is the quantile over all languages.

Defined cases: a null language is a language; one without a trusted text has no model and rejects nothing,
nor does the only trusted text of a table give a limit; a document without tokens is rejected where its language has a threshold; repeated labels count once, a
document that any of its labels distrusts is not trusted; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswatch.llm.bytesops import SPACED_BYTES, WORD_BYTES, HashTable, slices, span_hashes
from presswatch.llm.common import fresh
from presswatch.llm.grams import PART_CHARS, chain, gram_counts, gram_key, looked_up, ranks, starts_of, units
from presswatch.operators.skew import fits, number_rows
from presswatch.session import released, staged

TOP = 1 << 20
FOLD_CHARS = 16_000_000  # of small languages in all folds at once
QUANTILE = 0.995
LEAST_HELD_OUT = 20
FOLDS = 5
ROUNDS = 8  # of the look-ups: the blocks of one round's documents go before the next
_KIND = np.zeros(256, dtype=np.int8)
_KIND[SPACED_BYTES] = 1
_KIND[WORD_BYTES] = 2
_KIND[65:91] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and of an end after each text (0), and the first token of each text."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    change = np.ones(len(data), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= edge[:-1]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], len(data))
    real = kind[runs] > 0
    runs, ends = runs[real], ends[real]
    hashes = span_hashes(data, runs, ends)
    first = np.searchsorted(runs, offsets)
    return np.insert(hashes, first[1:], np.uint64(0)), first + np.arange(len(first))


def gram_keys(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of (uvw), (uv), (vw), (v), (w) of each token, in its text's language, and the first token of each text."""
    w, first = tokens(data, offsets)
    place = np.arange(len(w)) - np.repeat(first[:-1], np.diff(first))
    start = np.uint64(1)
    v = np.where(place >= 1, np.roll(w, 1), start)
    u = np.where(place >= 2, np.roll(w, 2), start)
    own = np.repeat(lang, np.diff(first))
    return [gram_key(own, u, v, w), gram_key(own, u, v, own), gram_key(own, v, w), gram_key(own, own, v, own, own),
            gram_key(own, w)], first


def _lang_hash(batch_column: pa.Array) -> np.ndarray:
    names = batch_column.to_pylist()
    known: dict = {}
    for name in set(names):
        raw = np.frombuffer(("=" + name if name is not None else "null").encode(), np.uint8)
        known[name] = span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
    return np.array([known[n] for n in names], dtype=np.uint64)


def trusted_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, trust: Column,
                   per_language: int | None = None, chars: int | None = None) -> DataFrame:
    """(doc_id, lang, text, fold): the trusted documents, within bounds if given; folds are even within a language."""
    good = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(F.coalesce(trust, F.lit(False))).alias("good")).filter("good")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.length(text).alias("size"),
                         F.xxhash64(F.col(text)).alias("draw"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("draw")]
    numbered = number_rows(narrow.filter("size > 0").join(good, "doc_id"),
                           [F.col("lang").asc_nulls_first(), *order], "place")
    starts = numbered.groupBy(F.col("lang").alias("of")).agg(F.min("place").alias("start"))
    ranked = numbered.join(F.broadcast(starts) if fits(starts) else starts, F.col("lang").eqNullSafe(F.col("of"))).withColumn(
        "rank", F.col("place") - F.col("start") + 1)
    if per_language is not None:
        ranked = ranked.filter(F.col("rank") <= per_language)
    parts = ["doc_id", "draw", (F.col("rank") % FOLDS).cast("int").alias("fold"), F.col("size").cast("long").alias("size")]
    taken = ranked.select(*parts)
    if chars is not None:
        first = ranked.repartition(1).sortWithinPartitions("rank", F.col("lang").asc_nulls_first()).select(*parts)

        def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            room = chars
            for batch in batches:
                take = []
                for i, size in enumerate(batch.column(3).to_pylist()):
                    if size <= room:
                        room -= size
                        take.append(i)
                yield batch.take(pa.array(take, pa.int64()))

        # The rows come in order, in one partition; they hold no texts.
        taken = first.mapInArrow(fitting, first.schema)
    taken = staged(taken.drop("size"), "taken")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return staged(texts.withColumn("draw", F.xxhash64("text")).join(taken, ["doc_id", "draw"])
                  .dropDuplicates(["doc_id", "draw"]).select("doc_id", "lang", "text", "fold"), "trusted")


def cross_validated(sample: DataFrame, chars: int = FOLD_CHARS, top: int = TOP) -> DataFrame:
    """(lang, value): the perplexity of each text under a model of its language's texts in the other folds."""
    named = sample.select("lang", "text", "fold", F.to_json(F.struct("lang")).alias("name"))
    # A fold's model is that of a language of its own; in rounds of one fold where all together pass the bound.
    whole = sample.select(F.sum(F.length("text"))).first()[0] * (FOLDS - 1)
    rounds = [[k] for k in range(FOLDS)] if whole > chars else [[*range(FOLDS)]]
    out = None
    for folds in rounds:
        each = named.withColumn("test", F.explode(F.array(*[F.lit(k) for k in folds]))).withColumn(
            "part", F.concat_ws(" ", "test", "name"))
        table = learned(each.filter("test != fold").select(F.col("part").alias("lang"), "text"), top)
        values = staged(perplexities(each.filter("test = fold"), table, "text", "part", "value", ["lang"], rounds=1), "kn-folds")
        released(table[0])
        out = values if out is None else out.union(values)
    return out


def limits_of(sample: DataFrame, tried: DataFrame, quantile: float) -> DataFrame:
    """(lang, limit) of the languages in ``sample`` from the perplexities (lang, value) of texts held out."""
    tried = tried.filter("value IS NOT NULL")
    each = tried.groupBy(F.col("lang").alias("of")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(quantile)).alias("own"), F.percentile("value", F.lit(0.5)).alias("mid"))
    ratios = tried.join(each, F.col("lang").eqNullSafe(F.col("of"))).agg(
        F.percentile(F.col("value") / F.col("mid"), F.lit(quantile)), F.percentile("value", F.lit(quantile)))
    ratio, whole = ratios.first()
    limit = F.when(F.col("n") >= LEAST_HELD_OUT, F.col("own")).otherwise(
        F.coalesce(F.col("mid") * F.lit(ratio), F.lit(whole).cast("double")))
    langs = sample.select("lang").distinct()
    return langs.join(each, F.col("lang").eqNullSafe(F.col("of")), "left").select("lang", limit.alias("limit"))


def model(training: DataFrame) -> DataFrame:
    """(key, value, seen, kind): the probability of each gram and the left mass of each context, from (lang, text)."""
    names = ["uvw", "uv", "vw", "v", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _lang_hash(batch.column(0))
            for low, high, data, offsets in slices(batch.column(1)):
                keys, first = gram_keys(data, offsets, langs[low:high])
                own = np.repeat(langs[low:high], np.diff(first))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (own, *keys)],
                                                 names=["lang", *names])

    rows = training.select("lang", "text").mapInArrow(run, "lang long, " + ", ".join(f"{n} long" for n in names))
    # Each order is counted once, from the files of the one above.
    three = staged(rows.groupBy("lang", *names).agg(F.count(F.lit(1)).alias("n")), "kn-uvw")
    two = staged(three.groupBy("lang", "vw", "v", "w").agg(F.count(F.lit(1)).alias("n")), "kn-vw")
    one = staged(two.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")), "kn-w")
    out = below = None
    orders = ((one, "w", "lang", None), (two, "vw", "v", "w"), (three, "uvw", "uv", "vw"))
    for counted, key, context, shorter in orders:
        more = [F.col(shorter).alias("shorter")] if shorter else []
        table = counted.select("lang", F.col(key).alias("key"), F.col(context).alias("context"), "n", *more)
        times = [F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.expr("coalesce(n1 / nullif(n1 + 2 * n2, 0), 0)")
        discounts = table.groupBy("lang").agg(*times).select("lang", *[
            F.least(F.greatest(F.coalesce(
                i - (i + 1) * y * F.col(f"n{i + 1}") / F.expr(f"nullif(n{i}, 0)"), F.lit(0.5 * i)),
                F.lit(0.1 * i)), F.lit(0.95 * i)).alias(f"d{i}") for i in (1, 2, 3)])
        table = table.join(discounts, "lang")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        sums = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("left"),
                                            F.count(F.lit(1)).alias("kinds"))
        mass = F.col("left") / F.col("total")
        if shorter is None:
            mass = mass / (F.col("kinds") + 1)
        sums = staged(sums.withColumn("mass", mass), f"kn-{context}-sums")
        shares = table.join(sums, "context").withColumn("share", (F.col("n") - discount) / F.col("total"))
        if shorter is None:
            value = F.col("share") + F.col("mass")
        else:
            shares = shares.join(below.select(F.col("key").alias("shorter"), F.col("value").alias("p")), "shorter")
            value = F.col("share") + F.col("mass") * F.col("p")
        below = staged(shares.select("key", value.alias("value"), F.col("n").alias("seen")), f"kn-{key}-model")
        released(counted)
        # A language's own row comes first of all: tasks always know which languages have a model.
        rank = F.col("total") if shorter else F.lit(1 << 62)
        masses = sums.select(F.col("context").alias("key"), F.col("mass").alias("value"), rank.alias("seen"),
                             F.lit(context).alias("kind"))
        both = below.withColumn("kind", F.lit(key)).unionByName(masses)
        out = both if out is None else out.unionByName(both)
    return out


def learned(training: DataFrame, top: int = TOP) -> tuple[DataFrame, int]:
    """The model of (lang, text), and the number of its parts: none if it goes to the tasks whole."""
    chars = training.select(F.sum(F.length("text") + 1)).first()[0] or 0
    if chars <= top:
        return model(training), 0
    parts = max(2 * training.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    return gram_counts(training.select("lang", "text"), _units, parts), parts


def _units(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    langs = _lang_hash(batch.column(0))
    for low, high, w, first in units(tokens, batch.column(1)):
        yield low, high, w, first, langs[low:high]


def _discounts(counts: np.ndarray) -> np.ndarray:
    """The discounts of counts 1, 2 and more (rows) of each language, from the numbers of grams of counts 1 to 4."""
    n = counts.astype(float)
    y = n[0] / np.maximum(n[0] + 2 * n[1], 1)
    found = [np.where(n[i - 1] > 0, i - (i + 1) * y * n[i] / np.maximum(n[i - 1], 1), 0.5 * i) for i in (1, 2, 3)]
    return np.stack([np.minimum(np.maximum(d, 0.1 * i), 0.95 * i) for i, d in enumerate(found, 1)])


def _perplexity(first: np.ndarray, p: np.ndarray, modelled: np.ndarray) -> np.ndarray:
    """Of each text, NaN without tokens or model; equal texts give equal numbers, wherever they stand."""
    count = np.diff(first)
    if not len(count):
        return np.zeros(0)
    value = np.exp(-np.add.reduceat(np.log(np.maximum(p, 1e-300)), first[:-1]) / count)
    return np.where(modelled & (count > 1), value, np.nan)


def smoothed(places: np.ndarray, words: np.ndarray, first: np.ndarray, own: np.ndarray,
             numbers: list[np.ndarray]) -> np.ndarray:
    """The perplexity of each text of a unit, from the counts of its different triples, pairs, words and languages."""
    triples, pairs, ones, langs = numbers
    at, size, start = first[:-1], len(places), starts_of(own)

    def rank(keys: np.ndarray, answered: np.ndarray) -> np.ndarray:
        different, places = ranks(keys)
        if len(different) != answered.shape[1]:
            raise ValueError("the answers are not those of this unit")
        return places

    _, _, _, vw, triple = chain(words[places], first, own)
    both = rank(np.concatenate([vw, gram_key(start, start)]), pairs)
    pair, before = both[:size], np.roll(both[:size], 1)
    before[at] = both[size:]
    last = np.roll(places, 1)
    last[at] = np.searchsorted(words, start)
    lang = rank(own, langs)
    of = np.repeat(lang, np.diff(first))

    def discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
        return n - d[np.clip(n, 1, 3).astype(np.int64) - 1, of]

    def left(context: np.ndarray, d: np.ndarray) -> np.ndarray:
        mass = sum(d[i][of] * context[i + 1] for i in range(3))
        return np.where(context[0] > 0, mass / np.maximum(context[0], 1), 1.0)

    one, two, three = (_discounts(langs[i:i + 4]) for i in (0, 4, 8))
    total, kinds = langs[12].astype(float), langs[13:].astype(float)
    rest = ((one * kinds).sum(axis=0) / np.maximum(total, 1) / (kinds.sum(axis=0) + 1))[of]
    p = np.where(ones[0][places] > 0, discounted(ones[0][places], one) / np.maximum(total, 1)[of] + rest, rest)
    for n, context, d in ((pairs[0][pair], ones[1:, last], two), (triples[0][rank(triple, triples)], pairs[1:, before], three)):
        context = context.astype(float)
        p = left(context, d) * p
        p += np.where(n > 0, discounted(n, d) / np.maximum(context[0], 1), 0.0)
    return _perplexity(first, p, (total > 0)[lang])


def perplexities(docs: DataFrame, learnt: tuple[DataFrame, int], text: str, lang: str, out: str, keep: list[str],
                 rounds: int = ROUNDS) -> DataFrame:
    """``keep`` columns and ``out``: the perplexity, null without tokens or for a language without a model.

    A model without parts goes to the tasks. Otherwise the documents ask its parts in ``rounds``: less room, but the
    model moves each time.
    """
    table, parts = learnt
    asked = docs.select(F.col(lang).alias(fresh("lang", docs)), F.col(text).alias(fresh("text", docs)), *keep)
    if parts:
        narrow = asked.columns[:2]
        done = [staged(looked_up(asked.filter(F.pmod(F.xxhash64(narrow[1]), F.lit(rounds)) == k), keep, table, parts, _units,
                                 smoothed, out), "kn-scores") for k in range(rounds)]
        return reduce(DataFrame.unionAll, done)
    rows = table.select("key", "value").toArrow()  # as many as the model has characters, a few times, at most
    sent = docs.sparkSession.sparkContext.broadcast(
        (rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy()))
    value = fresh("value", docs)
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(f"`{value}` double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HashTable(*sent.value)
        for batch in batches:
            langs = _lang_hash(batch.column(0))
            for low, high, data, offsets in slices(batch.column(1)):
                own = langs[low:high]
                (uvw, uv, vw, v, w), first = gram_keys(data, offsets, own)
                rest, modelled = known.look_up(own)
                p = np.repeat(rest, np.diff(first))
                for gram, context in ((w, None), (vw, v), (uvw, uv)):
                    if context is not None:
                        mass, seen = known.look_up(context)
                        p = np.where(seen, mass, 1.0) * p
                    share, seen = known.look_up(gram)
                    p = np.where(seen, share, p)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(low, high - low) for c in batch.columns[2:]),
                     pa.array(_perplexity(first, p, modelled), from_pandas=True)], names=schema.names)

    return asked.mapInArrow(run, schema).withColumnRenamed(value, out)


def quality(docs: DataFrame, labels: DataFrame, trust: Column, doc_id: str = "doc_id", text: str = "text",
            lang: str = "lang", perplexity: str = "perplexity", threshold: str = "threshold", kept: str = "kept",
            keep: list[str] | None = None, per_language: int | None = None, chars: int | None = None,
            quantile: float = QUANTILE, only_kept: bool = False, top: int = TOP) -> DataFrame:
    """``keep`` (by default all) columns of ``docs`` with perplexity, its language's threshold, and ``kept``.

    With ``only_kept`` the result is the kept documents with their own columns. ``trust`` is a condition on a row of ``labels`` (with the same ``doc_id`` column): its text is trusted.
    """
    sample = trusted_sample(docs, labels, doc_id, text, lang, trust, per_language, chars)
    held = F.count_if(F.col("fold") >= 3)
    few = staged(sample.groupBy(F.col("lang").alias("of")).agg(held.alias("n")).filter(F.col("n") < LEAST_HELD_OUT), "kn-few")
    same = F.col("lang").eqNullSafe(F.col("of"))
    large, small = sample.join(few, same, "left_anti"), sample.join(few, same, "left_semi")
    learnt = learned(large.filter("fold < 3").union(small).select("lang", "text"), top)
    tried = perplexities(large.filter("fold >= 3"), learnt, "text", "lang", "value", ["lang"], rounds=1)
    if not few.isEmpty():
        tried = tried.union(cross_validated(small, chars or FOLD_CHARS, top))
    values = staged(tried, "kn-tried")
    limits = staged(limits_of(sample, values, quantile), "kn-limits")
    released(sample, tried, values)
    source, source_text, source_lang = docs, text, lang
    if only_kept:  # texts and other columns do not move with the scores; equal texts of a language have one verdict
        docs = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("draw"))
        lang, text, keep = "lang", "text", ["lang", "draw"]
        perplexity, threshold, kept = "perplexity", "threshold", "kept"
    names = [c for c in (keep or docs.columns) if c not in (perplexity, threshold, kept)]
    limit, other = fresh("limit", docs), fresh("limit_lang", docs)
    key = fresh("lang_key", docs)
    scored = perplexities(docs.withColumn(key, F.col(lang)), learnt, text, lang, perplexity, [*names, key])
    released(learnt[0])
    limits = limits.select(F.col("lang").alias(other), F.col("limit").alias(limit))
    joined = scored.join(F.broadcast(limits) if limits.count() <= 10_000 else limits,
                         F.col(key).eqNullSafe(F.col(other)), "left")
    good = F.when(F.col(limit).isNull(), True).otherwise(F.coalesce(F.col(perplexity) <= F.col(limit), F.lit(False)))
    out = joined.select(*names, perplexity, F.col(limit).alias(threshold), good.alias(kept))
    if not only_kept:
        return out
    of, draw = fresh("of_lang", source), fresh("of_draw", source)
    gone = staged(out.filter(~F.col(kept)).select(F.col("lang").alias(of), F.col("draw").alias(draw)).distinct(), "kn-rejected")
    return source.join(gone, (F.xxhash64(F.col(source_text)) == F.col(draw)) & F.col(source_lang).eqNullSafe(F.col(of)), "left_anti")
