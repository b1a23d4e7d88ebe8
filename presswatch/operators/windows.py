"""Time-window counts, batch form. The streaming module uses the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_counts(df: DataFrame, key: str, ts: str = "Timestamp", size: str = "5 hours",
                   slide: str = "1 hour") -> DataFrame:
    """Rows per sliding window and key."""
    return df.groupBy(F.window(ts, size, slide).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("win_start"), key, "n")


def tumbling_counts(df: DataFrame, key: str, ts: str = "Timestamp", size: str = "1 hour") -> DataFrame:
    """Rows per tumbling window and key."""
    return df.groupBy(F.window(ts, size).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("win_start"), key, "n")
