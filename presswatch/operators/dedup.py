"""Keep-first deduplication, top-n per key, set union.

``row_number() <= n`` is planned with a per-task group limit before the shuffle, so of a key that
holds a third of all rows each map task sends on at most ``n`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (null keys form one group)."""
    position = rank or "_position"
    out = df.withColumn(
        position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(position) <= n)
    return out if rank else out.drop(position)


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """Keep-first deduplication with an explicit order."""
    return top_per_key(df, keys, order, 1)


def first_per_url(df: DataFrame) -> DataFrame:
    """One row per URL, the earliest ingested; a null URL counts as one URL."""
    return first_per_key(df, ["URL"], [F.col("ingest_seq").asc()])


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in any of ``columns`` go."""
    return df.dropna(subset=list(columns))


def distinct_articles(df: DataFrame) -> DataFrame:
    """URL deduplication first, then the null-description drop: a first copy without text hides later ones."""
    return drop_missing(first_per_url(df), "Description")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by column name; columns absent on one side are null there."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def union_distinct(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name without repeated rows (typed values, so a re-archived row is recognised)."""
    return union_all(first, *others).distinct()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
