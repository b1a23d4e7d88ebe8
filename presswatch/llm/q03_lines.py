"""Query of the line deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.common import read
from presswatch.llm.lines import without_similar_lines
from presswatch.llm.registry import query


@query("op3_similar_lines")
def op3_similar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that have a similar earlier line, and the numbers of those lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_similar_lines(docs, removed="removed_lines").select(
        "doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
