"""Query of the licence scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswatch.llm.common import read
from presswatch.llm.licences import RESULT, licences
from presswatch.llm.registry import query


@query("op11_licences")
def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base licence phrases and the labels of verified template alignments in every document."""
    return licences(read(spark, sf_dir, "documents")).select("doc_id", *RESULT)
