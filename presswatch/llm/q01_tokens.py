"""Query of the token-id output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.llm.common import read
from presswatch.llm.registry import query
from presswatch.llm.wavelet import block_starts, documents, read_shards, write_shards
from presswatch.session import work_path


@query("op1_token_shards")
def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents, read the files back and describe each document's ids."""
    folder = work_path(spark, "token-shards")
    write_shards(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    shards = read_shards(spark, folder)
    found = documents(shards).select("part", "block", "at", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return found.join(block_starts(shards), ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
