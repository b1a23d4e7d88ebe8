"""The periodic jobs. A failing step stops the job; each step can be repeated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch import schemas
from presswatch.config import DEFAULTS, Settings
from presswatch.operators.enrich import Extractor
from presswatch.operators.report import alert_board, category_panels, nuclear_panel
from presswatch.operators.rules import Rules
from presswatch.plans.enrichment import enrich_delta
from presswatch.plans.ingest import LandedReplies, as_of_literal, ingest_regular, ingest_trending
from presswatch.plans.topics import run_topics
from presswatch.session import work_tables
from presswatch.sources.tables import read_table, retire_all

TABLES = {"articles": schemas.ARTICLES, "enriched": schemas.ENRICHED}


@dataclass(frozen=True)
class Store:
    """Folders of one deployment, all on storage that every executor reaches."""

    root: str

    @property
    def data(self) -> str:
        return f"{self.root}/data"

    @property
    def backup(self) -> str:
        return f"{self.root}/backup"

    @property
    def articles(self) -> str:
        return f"{self.data}/articles"

    @property
    def enriched(self) -> str:
        return f"{self.data}/enriched"

    @property
    def topics(self) -> str:
        return f"{self.root}/topics"

    @property
    def topic_model(self) -> str:
        return f"{self.root}/topic_model"


def clean_old_data(spark: SparkSession, store: Store, as_of: str, settings: Settings = DEFAULTS) -> dict[str, int]:
    """Retention over all stored tables; returns removed rows per table and in total."""
    return retire_all(spark, store.data, store.backup, TABLES, as_of, settings.days_to_keep)


def process_news(spark: SparkSession, store: Store, as_of: str,
                 make_extractor: Callable[[], Extractor] | None = None, rules: Rules | None = None,
                 settings: Settings = DEFAULTS, refit: bool = True) -> dict[str, str]:
    """Enrich what is new, then topics over the enriched table: refitted and saved, or, without ``refit``,
    assigned by the saved model when there is one."""
    table = enrich_delta(spark, store.articles, store.enriched, as_of, make_extractor, rules, settings)
    return run_topics(table.drop("date"), store.topics, settings=settings, model_path=store.topic_model,
                      refit=refit)


def hourly_job(spark: SparkSession, store: Store, landed: LandedReplies, batch_id: int, as_of: str,
               make_extractor: Callable[[], Extractor] | None = None, rules: Rules | None = None,
               settings: Settings = DEFAULTS, refit: bool = False) -> dict[str, str]:
    """Ingest, retention, enrichment of what is new, topics; returns the report paths.

    Topics come from the saved model unless ``refit`` is on or none is saved yet (the daily job refits).
    """
    with work_tables(spark):
        since = as_of_literal(as_of) - F.expr(f"INTERVAL {settings.regular_hours} HOURS")
        ingest_regular(spark, landed, batch_id, store.articles, since)
        clean_old_data(spark, store, as_of, settings)
        return process_news(spark, store, as_of, make_extractor, rules, settings, refit)


def daily_job(spark: SparkSession, store: Store, landed: LandedReplies, batch_id: int, as_of: str,
              make_extractor: Callable[[], Extractor] | None = None, rules: Rules | None = None,
              settings: Settings = DEFAULTS) -> dict[str, str]:
    """Trending articles first, so that they win over regular copies, then the hourly job."""
    with work_tables(spark):
        since = as_of_literal(as_of) - F.expr(f"INTERVAL {settings.trending_days} DAYS")
        ingest_trending(spark, landed, batch_id, store.articles, since)
    return hourly_job(spark, store, landed, batch_id + 1, as_of, make_extractor, rules, settings, refit=True)


def report_tables(enriched: DataFrame, as_of: Column, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """The three parts of the alert report."""
    return {
        "nuclear": nuclear_panel(enriched),
        "categories": category_panels(enriched, limit=settings.panel_limit),
        "alerts": alert_board(enriched, as_of, settings.alert_hours),
    }


def stored_report(spark: SparkSession, store: Store, as_of: Column, settings: Settings = DEFAULTS
                  ) -> dict[str, DataFrame]:
    return report_tables(read_table(spark, store.enriched, schemas.ENRICHED), as_of, settings)
