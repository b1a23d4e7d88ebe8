"""Query of the BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.bpe import decoded, encoded
from presswatch.llm.common import read
from presswatch.llm.registry import query


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and the text decoded from them, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encoded(read(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return decoded(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
