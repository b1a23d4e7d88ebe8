"""Query of the substring deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.common import read
from presswatch.llm.registry import query
from presswatch.llm.repeats import without_repeats


@query("op6_repeated_units")
def op6_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines and sentences that an earlier place holds, and what was cut where."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_repeats(docs, spans="cuts", lines=True)
    return out.select(
        "doc_id", "text", F.size("cuts").cast("long").alias("n_cut"),
        F.array_join(F.transform("cuts", lambda c: F.concat_ws(":", c["start"], c["end"])), ",").alias("cut_spans"),
        F.array_sort(F.array_distinct(F.transform("cuts", lambda c: c["first_id"]))).alias("first_doc_ids"))
