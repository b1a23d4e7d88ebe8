"""Rows that are not in the processed table yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.operators.skew import BROADCAST_ROWS, SALTS, fits
from presswatch.session import staged


def not_processed(
    fresh: DataFrame,
    done: DataFrame,
    key: str = "URL",
    retry_failed: bool = False,
    response: str = "LLM_Response",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Anti-join on ``key``; a null key equals a null key.

    Failed enrichments (null response) count as processed unless ``retry_failed``. When the fresh
    keys are few, the large processed table is only scanned for them and never shuffled. Otherwise
    the keys are compared first, without their rows: when few are new, the fresh rows are only scanned
    for these, else they shuffle with the rows of one key spread over several tasks. Nothing moves
    when nothing is processed yet.
    """
    if retry_failed:
        done = done.filter(F.col(response).isNotNull())
    seen = done.select(F.col(key).alias("_seen"))
    if seen.isEmpty():
        return fresh
    fresh_keys = fresh.select(F.col(key).alias("_key")).distinct()
    if fits(fresh_keys, broadcast_rows):
        hits = seen.join(F.broadcast(fresh_keys), F.col("_seen").eqNullSafe(F.col("_key")), "left_semi").distinct()
        return fresh.join(F.broadcast(hits), F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
    new = staged(fresh_keys.join(seen.distinct(), F.col("_key").eqNullSafe(F.col("_seen")), "left_anti"), "new-keys")
    if fits(new, broadcast_rows):
        return fresh.join(F.broadcast(new), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    told_apart = ["ingest_seq"] if "ingest_seq" in fresh.columns else fresh.columns
    salted = fresh.withColumn("_salt", F.pmod(F.xxhash64(*told_apart), F.lit(SALTS)).cast("int"))
    repeated = new.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(
        repeated,
        F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_copy")),
        "left_semi",
    ).drop("_salt")
