"""Query of the conversation structure repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswatch.llm.common import read
from presswatch.llm.registry import query
from presswatch.llm.repair import repaired_conversations


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation; SQL cannot say the derivation (tested by brute force)."""
    return repaired_conversations(read(spark, sf_dir, "conversations"))
