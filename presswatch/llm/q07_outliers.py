"""Query of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswatch.llm.common import read
from presswatch.llm.outliers import judged
from presswatch.llm.registry import query


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether rules and robust distance keep it."""
    out = judged(read(spark, sf_dir, "documents"), keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "distance")
