"""Enrich articles that are not in the enriched table yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch import schemas
from presswatch.config import DEFAULTS, Settings
from presswatch.operators.delta import not_processed
from presswatch.operators.enrich import DEFAULT_TEMPLATE, Extractor, with_enrichment, with_prompt, with_replies
from presswatch.operators.rules import Rules, document_frequencies, keyword_table, with_rule_replies
from presswatch.operators.skew import in_slices, spread_out
from presswatch.session import released, staged
from presswatch.sources.tables import append_table, read_table


def enriched(articles: DataFrame, as_of: str, make_extractor: Callable[[], Extractor] | None = None,
             rules: Rules | None = None, settings: Settings = DEFAULTS,
             template: str = DEFAULT_TEMPLATE, keywords: DataFrame | None = None) -> DataFrame:
    """Article rows plus the enrichment columns, from a user's extractor or else the built-in rules.

    ``keywords`` are those of the articles, if the rules shall not work them out from ``articles`` alone.
    """
    if make_extractor is None:
        placed = articles if keywords is not None else spread_out(articles, "ingest_seq")
        raw = with_rule_replies(placed, rules, keywords=keywords)
    else:
        raw = with_replies(
            with_prompt(articles, template), make_extractor, settings.max_attempts,
            settings.retry_wait_seconds, settings.enrich_partitions)
    done = with_enrichment(raw, settings.model, F.lit(as_of).cast("timestamp"))
    return done.select(*schemas.ENRICHED.fieldNames())


def enrich_delta(spark: SparkSession, articles: str, table: str, as_of: str,
                 make_extractor: Callable[[], Extractor] | None = None, rules: Rules | None = None,
                 settings: Settings = DEFAULTS, retry_failed: bool = False) -> DataFrame:
    """Enrich only URLs without a stored result and append them; an extractor's replies are written once,
    before use (the rules give the same reply each time).

    A large table is enriched and appended in slices, words weighted by the frequencies in all of it. A run that is
    cut short leaves the slices it finished, which the next one finds processed.
    """
    stored = read_table(spark, table, schemas.ENRICHED)
    fresh = read_table(spark, articles, schemas.ARTICLES).drop("date")
    todo = not_processed(fresh, stored, retry_failed=retry_failed)
    if todo is not fresh:  # else it is the article table as it lies there
        todo = staged(todo, "todo")
    if not todo.isEmpty():
        parts = in_slices(todo, "ingest_seq")
        n = len(parts)
        known = document_frequencies(spread_out(todo, "ingest_seq")) if make_extractor is None else None
        for part in parts:
            if known is None:
                own = done = staged(enriched(part, as_of, make_extractor, settings=settings), "enriched")
            else:
                own = staged(keyword_table(spread_out(part, "ingest_seq", n), known=known), "keywords")
                done = enriched(part, as_of, rules=rules, settings=settings, keywords=own)
            append_table(done, table)
            released(own)
        if known is not None:
            released(known[0])
    return read_table(spark, table, schemas.ENRICHED)
