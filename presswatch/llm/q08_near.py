"""Query of the near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswatch.llm.common import read
from presswatch.llm.near import near_classes
from presswatch.llm.registry import query


@query("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document: documents linked by a probability Jaccard of 0.8 or more of their shingles."""
    return near_classes(read(spark, sf_dir, "documents"))
