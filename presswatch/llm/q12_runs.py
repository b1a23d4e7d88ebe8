"""Query of the periodic run detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.common import read
from presswatch.llm.registry import query
from presswatch.llm.runs import periodic_runs


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every damaged document: count, the longest, digests of all runs and of the collapsed words.

    SQL would need every period of every document; the query is tested against brute force instead.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(docs, damage_key=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform(F.array_sort(F.transform("runs", lambda r: F.struct(
        r["start"].alias("s"), r["period"].alias("p"), r["length"].alias("l")))),
        lambda r: F.concat(r["s"].cast("string"), F.lit(","), r["l"].cast("string"), F.lit(","),
                           r["p"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-longest["s"]).alias("start"), longest["l"].alias("length"), (-longest["p"]).alias("period"),
        F.floor(longest["l"] * 1000 / -longest["p"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
