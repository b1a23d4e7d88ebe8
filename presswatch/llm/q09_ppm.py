"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.common import read
from presswatch.llm.ppm import scored
from presswatch.llm.registry import query


@query("op9_ppm_scores")
def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document; a seventh of them, by the checksum of the id, does not train."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return scored(read(spark, sf_dir, "documents"), held_out)
