"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.common import read
from presswatch.llm.kneser_ney import quality
from presswatch.llm.registry import query

TRUST = "quality = 1 AND toxic = 0"


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every document under its language's model of trusted text, and the verdict."""
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.expr(TRUST),
                   keep=["doc_id", "lang"])
