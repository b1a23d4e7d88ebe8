"""Token ids as wavelet matrices in compressed files.

Layout: ``write_shards`` ranges the documents by id, so that each output file (shard) holds the next run
of documents, and fills it with blocks of about ``BLOCK_TOKENS`` ids, whole documents each. A row is a
block: its documents' ids and lengths, and the wavelet matrix of its tokens - one packed bit plane for
each bit of an id, from the highest, the number of zeros in the plane, and the ones before each 512th bit.
The Spark writer makes the files, so a lost executor costs a retry and any storage that Spark reaches
will do; Parquet compresses the planes (zstd).

A plane and its counts give rank in constant time; access walks one place down the planes, counting two
places, and the place of the k-th occurrence walks back up with select. All work on the packed planes.

Defined cases: a null or empty text is a document of the end id alone; a null document id sorts first;
equal ids keep a fixed order by text; no documents give no blocks; other columns are not stored.
"""

from __future__ import annotations

import builtins
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswatch.llm.bpe import byte_names

BLOCK_TOKENS = 1 << 19
CACHE = 1_000_000
STEP = 512
SLICE = 2048
SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(SYMBOLS)}]*)")
_BYTE_NAMES = dict(enumerate(byte_names()))
BLOCK_SCHEMA = (
    "part int, block int, n_tokens long, doc_ids array<long>, lengths array<int>, zeros array<long>, "
    "planes array<binary>, ranks array<binary>")


class WaveletMatrix:
    """A sequence of ids below 2^levels as bit planes with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels):
            bit = now & now.dtype.type(1 << (levels - 1 - level)) != 0
            plane = np.zeros(-(-len(ids) // STEP) * STEP // 8, dtype=np.uint8)
            packed = np.packbits(bit, bitorder="little")
            plane[:len(packed)] = packed
            planes.append(plane)
            ranks.append(cls._ranks(plane))
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)  # places are faster than masks
            zeros.append(len(low))
            now = now[np.concatenate([low, high])]
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _ranks(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 bits."""
        ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, STEP // 64).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before place ``at``."""
        block, plane = at // STEP, self.planes[level]
        bits = int.from_bytes(plane[block * STEP // 8:-(-at // 8)].tobytes(), "little")
        return int(self.ranks[level][block]) + (bits & (1 << at - block * STEP) - 1).bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        counts = self.ranks[level]
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * STEP, self.n) - counts
        block = int(np.searchsorted(counts, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * STEP // 8:(block + 1) * STEP // 8], bitorder="little")
        return block * STEP + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][at >> 3]) >> (at & 7) & 1
            ones = self._ones(level, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        levels = len(self.zeros)
        if token < 0 or token >> levels:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zeros + a, zeros + b) if token >> (levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id stands in a range of places."""
        begin, end = self._range(token, low, self.n if high is None else high)
        return end - begin

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        begin, end = self._range(token, 0, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(f"id {token} has no occurrence {k}")
        at, levels = begin + k, len(self.zeros)
        for level in range(levels - 1, -1, -1):
            bit = token >> (levels - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        levels = len(self.zeros)
        now = np.zeros(self.n, dtype=np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            now[self.zeros[level]:] |= now.dtype.type(1 << (levels - 1 - level))
            above = np.empty_like(now)
            above[np.flatnonzero(~bit)] = now[:self.zeros[level]]
            above[np.flatnonzero(bit)] = now[self.zeros[level]:]
            now = above
        return now


def _tokenizer(path: str):
    """The tokenizer of a file and the ids of the chunks it has met, kept by the worker process."""
    kept = builtins.__dict__.setdefault("_presswatch_tokenizer", {})
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        kept[path] = (tokenizer, {})
    return kept[path]


def _pieces(cut: str) -> tuple[str, ...]:
    """What a cut falls into for certain: letters, and the ASCII symbols after them; Latin-1 in lower case.

    Apostrophes are no such symbols: the splitting pattern has pieces like 's.
    """
    if found := LATIN.fullmatch(cut):
        word, tail = found.groups()
        return (word.lower(), tail) if tail else (word.lower(),)
    word = cut.rstrip(SYMBOLS)
    if not unicodedata.normalize("NFC", word).lower().isalpha():  # some letters fall into a letter and a mark
        return (cut,)
    return (word, cut[len(word):]) if len(word) < len(cut) else (word,)


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """The ids of whole texts, 32 bits each.

    The splitting pattern of the vocabulary drops white space and no piece crosses it, so a text is cut at
    spaces and line ends, the cuts are numbered by Arrow, and the library encodes each distinct piece of a
    cut once; the ids of all cuts are then gathered by number.
    """
    tokenizer, known = _tokenizer(path)
    if len(known) > CACHE:
        known.clear()
    if not texts:
        return []
    cut_lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
    numbered = cut_lists.values.dictionary_encode()
    cuts = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
    raw = list(map(known.get, cuts))
    new = {c: _pieces(c) for c, own in zip(cuts, raw, strict=True) if own is None}
    # Letters alone are one piece for the model after the normal form; anything else takes the whole library path.
    model, normal, others = tokenizer.model.tokenize, tokenizer.normalizer.normalize_str, []
    for piece in set(chain.from_iterable(new.values())):
        if piece in known:
            continue
        word = piece if LATIN.fullmatch(piece) else normal(piece)
        if not (piece.isalpha() and word.isalpha()):
            others.append(piece)
            continue
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTE_NAMES)
        known[piece] = array("I", [t.id for t in model(word)]).tobytes()
    for piece, found in zip(others, tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
        known[piece] = array("I", found.ids).tobytes()
    for cut, own in new.items():
        known[cut] = known[own[0]] if len(own) == 1 else known[own[0]] + known[own[1]]
    raw = [known[c] if own is None else own for c, own in zip(cuts, raw, strict=True)]
    flat = pa.array(raw, pa.large_binary()).take(numbered.indices)
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    ids = memoryview(flat.buffers()[2] or b"")
    return [bytes(ids[a:b]) for a, b in pairwise(ends[cut_lists.offsets.to_numpy()].tolist())]


def blocks(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], levels: int, end_id: int,
           doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The blocks of the shards (``BLOCK_SCHEMA``), in order of ``doc_id`` over parts and blocks."""
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int32())), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            lengths = [len(p) // 4 for p in parts]
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(parts), dtype="<u4"), levels)
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": number, "n_tokens": sum(lengths), "doc_ids": ids, "lengths": lengths,
                "zeros": matrix.zeros, "planes": [p.tobytes() for p in matrix.planes],
                "ranks": [r.astype("<u4").tobytes() for r in matrix.ranks]}], schema=schema)

        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                piece = batch.slice(low, SLICE)
                found = encode([t or "" for t in piece.column(1).to_pylist()])
                for name, own in zip(piece.column(0).to_pylist(), found, strict=True):
                    ids.append(name)
                    parts.append(own + tail)
                    size += len(own) // 4 + 1
                    if size >= block_tokens:
                        yield block()
                        number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCK_SCHEMA))


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 1, levels: int = 16,
                 doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts with the vocabulary at ``path``, append ``end_id``, write one file per shard."""
    encoded = blocks(docs, lambda texts: encode_texts(path, texts), levels, end_id, doc_id, text)
    encoded.write.option("compression", "zstd").mode("overwrite").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(folder)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(
        row["n_tokens"], row["zeros"], [np.frombuffer(p, np.uint8) for p in row["planes"]],
        [np.frombuffer(r, dtype="<u4") for r in row["ranks"]])


def block_starts(shards: DataFrame) -> DataFrame:
    """(part, block, start): the ids of all blocks before. Summed per file first, so no task sees all blocks."""
    sizes = shards.select("part", "block", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select(
        "part", "block",
        (F.col("parts_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def documents(shards: DataFrame) -> DataFrame:
    """(part, block, at, doc_id, n_tokens, ids): each document from the files, its ids as binary uint32."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                flat = _matrix(row).decode().astype("<u4").tobytes()
                ends = np.cumsum([0, *row["lengths"]]).tolist()
                n = len(row["doc_ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                    pa.array(ends[:-1], pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array([flat[4 * a:4 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())],
                    schema=schema)

    return shards.mapInArrow(run, "part int, block int, at long, doc_id long, n_tokens long, ids binary")


def token_counts(shards: DataFrame, token: int) -> DataFrame:
    """(part, block, n): how often an id stands in each block, by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([r["part"] for r in rows], pa.int32()),
                "block": pa.array([r["block"] for r in rows], pa.int32()),
                "n": pa.array([_matrix(r).count(token) for r in rows], pa.int64())})

    return shards.mapInArrow(run, "part int, block int, n long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, at): each place of an id, counted from the start of its document, by select alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix, ends = _matrix(row), np.cumsum([0, *row["lengths"]])
                places = np.array([matrix.select(token, k) for k in range(matrix.count(token))], dtype=np.int64)
                doc = np.searchsorted(ends, places, "right") - 1
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([row["doc_ids"][d] for d in doc.tolist()], pa.int64()),
                    "at": pa.array(places - ends[doc], pa.int64())})

    return shards.mapInArrow(run, "doc_id long, at long")
