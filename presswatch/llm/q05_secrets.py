"""Query of the secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.common import read
from presswatch.llm.registry import query
from presswatch.llm.secrets import KINDS, secret_spans


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in every document, those of the fixed patterns counted and as a digest."""
    found = secret_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), F.expr("quality = 1"))
    base = F.filter("spans", lambda s: s["kind"] != "markov")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(kind) for kind in KINDS[:3]],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
