"""Row predicates of the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.config import NUCLEAR_CATEGORIES


def relevant(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Relevance") == "Yes")


def in_categories(df: DataFrame, categories: Sequence[str] = NUCLEAR_CATEGORIES) -> DataFrame:
    return df.filter(F.col("NewsCategory").isin(*categories))


def with_flag(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col("AlertFlag") == flag)


def newer_than(df: DataFrame, as_of: Column, hours: int = 5, ts: str = "Timestamp") -> DataFrame:
    """Strictly newer than ``as_of - hours``."""
    return df.filter(F.col(ts) > as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))


def without_outliers(df: DataFrame, topic: str = "topic") -> DataFrame:
    return df.filter(F.col(topic) != -1)


def below_root(hierarchy: DataFrame) -> DataFrame:
    return hierarchy.filter(F.col("Parent_Name") != "Top")
