"""Source pulls over a landed article table: by category, by query text, by trending topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.functions.text import term_rows
from presswatch.operators.dedup import top_per_key
from presswatch.operators.skew import checked_join
from presswatch.session import staged


def since_filter(df: DataFrame, since: Column | None, ts: str = "Timestamp") -> DataFrame:
    return df if since is None else df.filter(F.col(ts) >= since)


def by_category(df: DataFrame, categories: Sequence[str], since: Column | None = None,
                category: str = "NewsCategory") -> DataFrame:
    """All categories in one pass; ``source_rank`` is the place of the category in the list."""
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category)).cast("int")
    return since_filter(df, since).filter(F.col(category).isin(*categories)).withColumn("source_rank", rank)


def by_query(df: DataFrame, queries: Sequence[str], since: Column | None = None, limit: int = 100,
             text: str = "Description") -> DataFrame:
    """Newest ``limit`` articles per query whose text contains it; an article may answer several.

    The query list is a parameter, so matching is one expression per row and no join.
    """
    body = F.lower(F.col(text))
    hits = F.array_compact(F.array(*[F.when(F.contains(body, F.lit(q.lower())), F.lit(q)) for q in queries]))
    matched = since_filter(df, since).withColumn("query", F.explode(hits))
    return top_per_key(
        matched, ["query"], [F.col("Timestamp").desc(), F.col("ingest_seq").asc()], limit, rank="position")


def trending_topics(df: DataFrame, since: Column | None = None, market: str | None = None) -> DataFrame:
    """Topics since a time, of one market, newest first."""
    df = since_filter(df, since)
    if market is not None:
        df = df.filter(F.col("Market") == market)
    return df.orderBy(F.col("Timestamp").desc(), F.col("Name").asc())


def best_article_per_topic(topics: DataFrame, articles: DataFrame, name: str = "Name",
                           text: str = "Description", placed: bool = False) -> DataFrame:
    """One article per topic: most shared terms, then newest, then first ingested.

    Terms join on equality. With a topic list that a row check finds small, articles are spread by
    their number once (not again with ``placed``: then the caller has spread them by it, in tasks of
    the size that the caller chose), so matches are counted where the article is and each task passes
    on only its best article per topic. A longer list takes the salted join. Topics are counted by
    number, their texts join the winners.
    """
    numbered = staged(topics.select(name).distinct().withColumn("_topic", F.monotonically_increasing_id()), "wanted")
    wanted = term_rows(numbered, name, keep=["_topic"], once=True)
    spread = articles.select("ingest_seq", "Timestamp", text)
    if not placed:
        spread = spread.repartition("ingest_seq")
    have = term_rows(spread, text, keep=["ingest_seq", "Timestamp"], once=True)
    score = (
        checked_join(have, wanted, ["term"], spread=["ingest_seq"])
        .groupBy("_topic", "ingest_seq", "Timestamp").agg(F.count(F.lit(1)).alias("score"))
    )
    best = top_per_key(
        score, ["_topic"], [F.col("score").desc(), F.col("Timestamp").desc(), F.col("ingest_seq").asc()], 1)
    return best.join(numbered, "_topic").select(name, "ingest_seq", "score")
