"""Alert report tables: nuclear list, category panels, last-hours board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.config import ALERT_FLAGS, NUCLEAR_CATEGORIES, PANEL_CATEGORIES
from presswatch.functions.scalars import alert_badge, flag_rank, heading, list_line
from presswatch.operators.dedup import first_per_key, top_per_key
from presswatch.operators.filters import in_categories, newer_than, relevant

SEQ = "ingest_seq"


def _newest() -> list[Column]:
    return [F.col("Timestamp").desc(), F.col(SEQ).asc()]


def _by_flag(tie: str) -> list[Column]:
    """Red, Yellow, Green, unknown; then newest first, or stored order with ``tie="ingest"``."""
    rank = flag_rank(F.col("AlertFlag")).asc_nulls_last()
    return [rank, F.col(SEQ).asc()] if tie == "ingest" else [rank, *_newest()]


def by_flag(df: DataFrame, tie: str = "newest") -> DataFrame:
    return df.orderBy(*_by_flag(tie))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(*_newest())


def nuclear_panel(df: DataFrame, categories: Sequence[str] = NUCLEAR_CATEGORIES) -> DataFrame:
    """Relevant nuclear articles by colour. Titles are deduplicated over all colours first, so the
    first stored copy decides the colour and later copies of other colours stay hidden."""
    titles = first_per_key(in_categories(relevant(df), categories), ["Title"], [F.col(SEQ).asc()])
    flag = F.col("AlertFlag")
    return titles.filter(flag.isin(*ALERT_FLAGS)).withColumns({
        "flag_rank": flag_rank(flag),
        "line": list_line(alert_badge(flag), F.col("Title"), F.col("URL")),
    })


def category_panels(df: DataFrame, categories: Sequence[str] = PANEL_CATEGORIES, limit: int = 10,
                    tie: str = "newest") -> DataFrame:
    """Top ``limit`` titles of each category, one pass for all categories."""
    order = _by_flag(tie)
    titles = first_per_key(in_categories(relevant(df), categories), ["NewsCategory", "Title"], order)
    return top_per_key(titles, ["NewsCategory"], order, limit, rank="position").withColumns({
        "heading": heading(F.col("NewsCategory")),
        "line": list_line(alert_badge(F.col("AlertFlag")), F.col("Title"), F.col("URL")),
    })


def alert_board(df: DataFrame, as_of: Column, hours: int = 5) -> DataFrame:
    """Relevant articles of the last hours, newest copy of each title within a colour."""
    recent = newer_than(relevant(df), as_of, hours).filter(F.col("AlertFlag").isin(*ALERT_FLAGS))
    titles = first_per_key(recent, ["AlertFlag", "Title"], _newest())
    return titles.withColumns({
        "flag_rank": flag_rank(F.col("AlertFlag")),
        "line": list_line(F.lit("•"), F.col("Title"), F.col("URL")),
    })
