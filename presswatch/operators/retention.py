"""Split stored rows at ``as_of - days``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT, ARCHIVED, REJECTED = "kept", "archived", "rejected"


def cutoff(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def with_retention(df: DataFrame, as_of: Column, days: int = 3, ts: str = "Timestamp") -> DataFrame:
    """Tag each row ``kept`` (at or after the cutoff), ``archived`` (before it) or ``rejected`` (no time)."""
    limit = cutoff(as_of, days)
    return df.withColumn(
        "retention",
        F.when(F.col(ts) >= limit, KEPT).when(F.col(ts) < limit, ARCHIVED).otherwise(REJECTED),
    )


def kept(df: DataFrame, as_of: Column, days: int = 3, ts: str = "Timestamp") -> DataFrame:
    return df.filter(F.col(ts) >= cutoff(as_of, days))


def archived(df: DataFrame, as_of: Column, days: int = 3, ts: str = "Timestamp") -> DataFrame:
    return df.filter(F.col(ts) < cutoff(as_of, days))


def rejected(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Rows without a usable time: kept apart instead of lost."""
    return df.filter(F.col(ts).isNull())


def removal_counts(tables: dict[str, DataFrame], as_of: Column, days: int = 3) -> DataFrame:
    """Archived-row count per table and over all of them, in one aggregation."""
    tagged = [
        with_retention(df, as_of, days).select(F.lit(name).alias("table_name"), "retention")
        for name, df in tables.items()
    ]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    return rows.rollup("table_name").agg(
        F.count_if(F.col("retention") == ARCHIVED).alias("removed"),
        F.count_if(F.col("retention") == KEPT).alias("remaining"),
        F.count_if(F.col("retention") == REJECTED).alias("rejected"),
    ).withColumn("table_name", F.coalesce("table_name", F.lit("total")))
