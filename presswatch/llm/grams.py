"""Counts of n-grams, and look-ups in them, as sorted arrays in parts by key.

Every row of a shuffle here is a block: the keys that one part sends to another, as bytes. A task sorts and adds up
blocks with numpy, so neither the JVM nor Python handles a gram on its own, whatever their number. A part is a range
of 64-bit keys, about ``PART_CHARS`` of training text, whatever the size of the corpus; blocks hold a key once, so
that a gram of every text is one entry a block.

Keys are of a language: word = (language, token), pair = (word, word), triple = (pair, word). The counts are those
of Kneser-Ney: how often a triple occurs, how many words stand before a pair and before a word, and for each pair
and word as a context the sum of these counts over what follows, and how many of them are 1, 2, and more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswatch.llm.bytesops import mix, slices
from presswatch.session import released, staged, staged_apart

PART_CHARS = 2 << 20
UNIT_TOKENS = 1 << 18
TRIPLE, PAIR, WORD, LANG = range(4)
DONE = 4  # and the kind: counts that are complete
#: Of each kind: the type of its numbers, and how many a key has.
KINDS = ((np.uint32, 1), (np.uint32, 5), (np.int64, 5), (np.int64, 16))
_COUNTED = "level int, part int, a binary, b binary, c binary, d binary, e binary, f binary"
_FIELDS = "abcdef"

Units = Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]


def gram_key(*parts: np.ndarray) -> np.ndarray:
    total = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for part in parts:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + part)
    return total


def units(tokens: Callable, column: pa.Array, limit: int = UNIT_TOKENS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, token hashes, first token of each text), whole texts, about ``limit`` tokens together."""
    held, size, begin = [], 0, 0

    def joined(high: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        shifts = np.cumsum([0, *(len(w) for w, _ in held)])
        first = np.concatenate([*(f[:-1] + s for (_, f), s in zip(held, shifts, strict=False)), shifts[-1:]])
        return begin, high, np.concatenate([w for w, _ in held]), first

    for _, high, data, offsets in slices(column):
        held.append(tokens(data, offsets))
        size += len(held[-1][0])
        if size >= limit:
            yield joined(high)
            held, size, begin = [], 0, high
    if held:
        yield joined(len(column))


def words_of(w: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Word keys of the tokens, in each text's language."""
    return gram_key(np.repeat(own, np.diff(first)), w)


def starts_of(own: np.ndarray) -> np.ndarray:
    """The word key that stands before each text."""
    return gram_key(own, np.ones(len(own), np.uint64))


def chain(word: np.ndarray, first: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """u and v, the words before each word, and the keys of (u, v), (v, w) and (u, v, w)."""
    at, start = first[:-1], starts_of(own)
    v = np.roll(word, 1)
    v[at] = start
    u = np.roll(v, 1)
    u[at] = start
    vw = gram_key(v, word)
    uv = np.roll(vw, 1)
    uv[at] = gram_key(start, start)
    return u, v, uv, vw, gram_key(uv, word)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, the places in it where a key begins, and the different keys."""
    order = np.argsort(keys)
    ranked = keys[order]
    at = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order, at, ranked[at]


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the place of each key among them."""
    order, at, different = grouped(keys)
    places = np.empty(len(keys), np.int32)
    places[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(keys))))
    return different, places


def distinct(keys: np.ndarray) -> np.ndarray:
    ranked = np.sort(keys)
    return ranked[np.r_[True, ranked[1:] != ranked[:-1]]] if len(keys) else ranked


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, axis=-1, dtype=values.dtype) if len(at) else values[..., :0]


def edges(parts: int) -> np.ndarray:
    """The least key of each part but the first."""
    return np.array([-(-(p << 32) // parts) << 32 for p in range(1, parts)], dtype=np.uint64)


def ranges(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where each part begins in sorted keys, and the end."""
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _of_contexts(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each context: the sum of the counts, and how many of them are 1, 2, and more."""
    return np.stack([sums(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts > 2)])


def _block(level: int, part: int, *fields: np.ndarray) -> tuple:
    return level, part, *(np.ascontiguousarray(x).tobytes() for x in fields), *[None] * (6 - len(fields))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=["level", "part", *_FIELDS])


def _of_langs(own: np.ndarray, counts: np.ndarray, order: int, bounds: np.ndarray) -> Iterator[tuple]:
    """Of each language, how many grams of this order have the counts 1, 2, 3 and 4; of words, also their sums."""
    rank, at, langs = grouped(own)
    ranked = counts[rank]
    numbers = np.zeros((16, len(langs)), np.int64)
    for i in range(4):
        numbers[4 * order - 4 + i] = sums((ranked == i + 1).astype(np.int64), at)
    if order == 1:
        numbers[12:] = _of_contexts(ranked, at)
    cut = ranges(langs, bounds)
    for p in np.flatnonzero(np.diff(cut)):
        yield _block(LANG, p, langs[cut[p]:cut[p + 1]], numbers[:, cut[p]:cut[p + 1]])


def _triples(part: int, got: dict, bounds: np.ndarray) -> Iterator[tuple]:
    u, v, w, own, n = (np.concatenate([np.frombuffer(x, t) for x in got[f]]) for f, t in zip(
        "abcde", (*[np.uint64] * 4, np.uint32), strict=True))
    uv, vw = gram_key(u, v), gram_key(v, w)
    order, at, keys = grouped(gram_key(uv, w))
    n, first = sums(n[order], at), order[at]
    yield _block(DONE + TRIPLE, part, keys, n)
    yield from _of_langs(own[first], n, 3, bounds)
    by_context = np.argsort(uv[first])
    contexts = uv[first][by_context]
    pairs, pair_at, pair_keys = grouped(vw[first])
    size, of = np.diff(np.append(pair_at, len(pairs))).astype(np.uint32), first[pairs[pair_at]]
    left, right = ranges(contexts, bounds), ranges(pair_keys, bounds)
    for p in range(len(left) - 1):
        a, b, c, d = left[p], left[p + 1], right[p], right[p + 1]
        if a < b or c < d:
            yield _block(PAIR, p, contexts[a:b], n[by_context[a:b]], v[of[c:d]], w[of[c:d]], own[of[c:d]], size[c:d])


def _merged(kind: int, part: int, grams: np.ndarray, n: np.ndarray, contexts: np.ndarray, numbers: np.ndarray) -> tuple:
    keys = distinct(np.concatenate([grams, contexts]))
    values = np.zeros((5, len(keys)), KINDS[kind][0])
    values[0, np.searchsorted(keys, grams)] = n
    values[1:, np.searchsorted(keys, contexts)] = numbers
    return _block(DONE + kind, part, keys, values)


def _pairs(part: int, got: dict, bounds: np.ndarray) -> Iterator[tuple]:
    before, n, v, w, own, size = (np.concatenate([np.frombuffer(x, t) for x in got[f]]) for f, t in zip(
        _FIELDS, (np.uint64, np.uint32, *[np.uint64] * 3, np.uint32), strict=True))
    order, at, contexts = grouped(before)
    numbers = _of_contexts(n[order], at)
    order, at, grams = grouped(gram_key(v, w))
    n, first = sums(size[order].astype(np.int64), at), order[at]
    yield _merged(PAIR, part, grams, n, contexts, numbers)
    yield from _of_langs(own[first], n, 2, bounds)
    order, at, contexts = grouped(v[first])
    numbers = _of_contexts(n[order], at)
    order, at, grams = grouped(w[first])
    size, of = np.diff(np.append(at, len(order))).astype(np.int64), own[first][order[at]]
    left, right = ranges(contexts, bounds), ranges(grams, bounds)
    for p in range(len(left) - 1):
        a, b, c, d = left[p], left[p + 1], right[p], right[p + 1]
        if a < b or c < d:
            yield _block(WORD, p, contexts[a:b], numbers[:, a:b], grams[c:d], size[c:d], of[c:d])


def _words(part: int, got: dict, bounds: np.ndarray) -> Iterator[tuple]:
    v, w, size, own = (np.concatenate([np.frombuffer(x, t) for x in got[f]]) for f, t in zip(
        "acde", (np.uint64, np.uint64, np.int64, np.uint64), strict=True))
    numbers = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in got["b"]], axis=1)
    order, at, contexts = grouped(v)
    numbers = sums(numbers[:, order], at)
    order, at, grams = grouped(w)
    n = sums(size[order], at)
    yield _merged(WORD, part, grams, n, contexts, numbers)
    yield from _of_langs(own[order[at]], n, 1, bounds)


def _langs(part: int, got: dict, bounds: np.ndarray) -> Iterator[tuple]:
    order, at, keys = grouped(np.concatenate([np.frombuffer(x, np.uint64) for x in got["a"]]))
    numbers = np.concatenate([np.frombuffer(x, np.int64).reshape(16, -1) for x in got["b"]], axis=1)
    yield _block(DONE + LANG, part, keys, sums(numbers[:, order], at))


def gram_counts(training: DataFrame, read_units: Units, parts: int) -> DataFrame:
    """(kind, part, keys, numbers): the counts of all orders from one pass over ``training``."""
    bounds = edges(parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w, first, own in read_units(batch):
                word = words_of(w, first, own)
                u, v, _, _, triple = chain(word, first, own)
                order, at, keys = grouped(triple)
                n, some = np.diff(np.append(at, len(order))).astype(np.uint32), order[at]
                lang = np.repeat(own, np.diff(first))[some]
                u, v, word = u[some], v[some], word[some]
                where = ranges(keys, bounds)
                yield _batch([_block(TRIPLE, p, *(x[where[p]:where[p + 1]] for x in (u, v, word, lang, n)))
                              for p in np.flatnonzero(np.diff(where))])

    def adding(add_up: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, got = None, {}
            for batch in batches:
                columns = [batch.column(2 + i) for i in range(6)]
                for i, part in enumerate(batch.column(1).to_pylist()):
                    if part != at:
                        if got:
                            yield _batch(list(add_up(at, got, bounds)))
                        at, got = part, {f: [] for f in _FIELDS}
                    for f, column in zip(_FIELDS, columns, strict=True):
                        if column[i].is_valid:
                            got[f].append(column[i].as_py())
            if got:
                yield _batch(list(add_up(at, got, bounds)))
        return run

    def added(rows: DataFrame, add_up: Callable) -> DataFrame:
        return rows.repartition("part").sortWithinPartitions("part").mapInArrow(adding(add_up), _COUNTED)

    def complete(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "part", F.col("a").alias("keys"), F.col("b").alias("numbers"))

    rows, model, langs = training.mapInArrow(cut, _COUNTED), [], []
    for level, add_up in enumerate((_triples, _pairs, _words)):
        got = staged_apart(added(rows, add_up), "kn-counts", "level")
        if level:
            released(rows)
        model.append(complete(got[str(DONE + level)], level))
        langs.append(got[str(LANG)].withColumn("level", F.lit(LANG)).select("level", "part", *_FIELDS))
        rows = got[str(level + 1)].withColumn("level", F.lit(level + 1)).select("level", "part", *_FIELDS) if level < WORD else None
    model.append(complete(staged(added(reduce(DataFrame.unionAll, langs), _langs), "kn-counts"), LANG))
    released(*langs)
    return reduce(DataFrame.unionAll, model)


_ASKED = "part int, unit long, turn int, place int, a binary, b binary, c binary, d binary"


def looked_up(docs: DataFrame, keep: list[str], model: DataFrame, parts: int, read_units: Units,
              score: Callable, out: str) -> DataFrame:
    """``keep`` columns of ``docs`` and ``out``: what ``score`` makes of the numbers of each text's grams.

    Units of texts ask each part once for the different keys they hold; the answers meet the unit's words again.
    """
    bounds = edges(parts)
    kept = docs.select(*keep).schema
    names = [f"_{i}" for i in range(len(kept))]
    fixed = [x.split(" ")[0] for x in _ASKED.split(", ")]
    schema = StructType.fromDDL(_ASKED)
    for name, field in zip(names, kept.fields, strict=True):
        schema = schema.add(name, field.dataType)
    fixed_types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def blocks(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), fixed_types, strict=True)),
             *(pa.nulls(len(rows), t) for t in types)], names=[*fixed, *names])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_units = TaskContext.get().partitionId(), 0
        for batch in batches:
            types = [c.type for c in batch.columns[2:]]
            for low, high, w, first, own in read_units(batch):
                word = words_of(w, first, own)
                _, _, _, vw, triple = chain(word, first, own)
                starts, langs = distinct(starts_of(own)), distinct(own)
                words, places = ranks(np.concatenate([word, starts]))
                keys = [distinct(triple), distinct(np.concatenate([vw, gram_key(starts, starts)])), words, langs]
                # The content is in the number: what another run of this task asked answers nothing here.
                n_units += 1
                unit = int(mix(np.bitwise_xor.reduce(triple, keepdims=True) + np.uint64((task << 32) + n_units)).view(np.int64)[0])
                n, to = high - low, unit % parts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, to, np.int32)), pa.array(np.full(n, unit)), pa.array(np.full(n, -2, np.int32)),
                     pa.array(np.arange(n, dtype=np.int32)), *(pa.nulls(n, pa.binary()) for _ in range(4)),
                     *(c.slice(low, n) for c in batch.columns[2:])], names=[*fixed, *names])
                rows = [(to, unit, -1, 0, *(np.ascontiguousarray(x).tobytes() for x in (places[:len(word)], words, first, own)))]
                where = [ranges(k, bounds) for k in keys]
                for p in range(parts):
                    if any(x[p] < x[p + 1] for x in where):
                        rows.append((p, unit, 1, p, *(k[x[p]:x[p + 1]].tobytes() for k, x in zip(keys, where, strict=True))))
                yield blocks(rows, types)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for batch in batches:
            turns = batch.column(2).to_numpy()
            passing = np.flatnonzero(turns < 0)
            if len(passing):
                yield batch.take(pa.array(passing))
            rows = []
            for i in np.flatnonzero(turns >= 0):
                part, unit, turn, place, *fields = (batch.column(j)[i].as_py() for j in range(8))
                if part != at:
                    at, known = part, {}
                if turn == 0:
                    kind, width = KINDS[place]
                    known[place] = np.frombuffer(fields[0], np.uint64), np.frombuffer(fields[1], kind).reshape(width, -1)
                    continue
                rows.append((part, unit, turn, place, *(
                    _found(known.get(k), np.frombuffer(x, np.uint64), *KINDS[k]).tobytes() for k, x in enumerate(fields))))
            if rows:
                yield blocks(rows, [c.type for c in batch.columns[8:]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, texts, words, got = None, [], None, []

        def scored() -> Iterator[pa.RecordBatch]:
            places, keys, first, own = (np.frombuffer(x, t) for x, t in zip(
                words, (np.int32, np.uint64, np.int64, np.uint64), strict=True))
            numbers = [np.concatenate([np.frombuffer(x[k], kind).reshape(width, -1) for x in got], axis=1)
                       for k, (kind, width) in enumerate(KINDS)]
            values = pa.array(score(places, keys, first, own, numbers), pa.float64(), from_pandas=True)
            low = 0
            for batch in texts:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, values.slice(low, len(batch))], names=[*names, "value"])
                low += len(batch)

        for batch in batches:
            number, turns = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (turns[1:] != turns[:-1])])
            for low, high in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                if number[low] != of:
                    if of is not None:
                        yield from scored()
                    of, texts, words, got = number[low], [], None, []
                if turns[low] == -2:
                    texts.append(pa.RecordBatch.from_arrays([c.slice(low, high - low) for c in batch.columns[8:]], names=names))
                else:
                    rows = list(zip(*(c.slice(low, high - low).to_pylist() for c in batch.columns[4:8]), strict=True))
                    if turns[low] == -1:
                        words = rows[0]
                    else:
                        got += rows
        if of is not None:
            yield from scored()

    requests = docs.mapInArrow(ask, schema)
    stored = model.select("part", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("turn"), F.col("kind").alias("place"),
                          F.col("keys").alias("a"), F.col("numbers").alias("b"), F.lit(None).cast("binary").alias("c"),
                          F.lit(None).cast("binary").alias("d"),
                          *(F.lit(None).cast(f.dataType).alias(n) for n, f in zip(names, kept.fields, strict=True)))
    answers = requests.unionAll(stored).repartition("part").sortWithinPartitions("part", "turn").mapInArrow(answer, schema)
    result = StructType([*schema.fields[8:], *StructType.fromDDL("value double").fields])
    done = answers.repartition("unit").sortWithinPartitions("unit", "turn", "place").mapInArrow(finish, result)
    return done.select(*(F.col(n).alias(f.name) for n, f in zip(names, kept.fields, strict=True)), F.col("value").alias(out))


def _found(known: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, kind: type, width: int) -> np.ndarray:
    """The numbers of each key, zeros where it has none."""
    if known is None or not len(known[0]) or not len(keys):
        return np.zeros((width, len(keys)), kind)
    at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
    return np.where(known[0][at] == keys, known[1][:, at], kind(0))
