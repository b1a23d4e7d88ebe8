"""A training-data pipeline over ``documents``: five stages, each one operator of ``presswatch.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Each result
is written and read again as the next stage's ``docs``. All but the last keep the columns of ``documents``;
what a stage removes is gone for the next. Empty tables, null ids, texts and languages, repeated rows and
further columns are handled as the operators' docstrings say; further columns pass through all stages but
the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.bpe import decoded, encoded
from presswatch.llm.common import read, small_batches
from presswatch.llm.decontaminate import without_contaminated
from presswatch.llm.kneser_ney import quality
from presswatch.llm.lines import without_similar_lines
from presswatch.llm.near import without_near_copies
from presswatch.llm.q02_quality import TRUST
from presswatch.session import staged

ENCODE_BYTES = 4 << 20  # of an Arrow batch: a task has two Python workers here, each with a vocabulary and its store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit; their text and columns as they were."""
    small_batches(spark)
    return quality(docs, read(spark, sf_dir, "labels"), F.expr(TRUST), only_kept=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that have a similar earlier line. ``n_chars`` follows the text."""
    small_batches(spark)
    return with_length(without_similar_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return without_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids of each text, and whether decoding gives it back."""
    small_batches(spark, ENCODE_BYTES)
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = decoded(encoded(docs, path, keep=["doc_id", "text"]), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` counted anew where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe encoding", encoding_stage),
]

# Perplexities, similarity joins and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
