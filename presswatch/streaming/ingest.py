"""Incremental ingest: URL deduplication under a watermark, appends that can be replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from presswatch.operators.dedup import distinct_articles
from presswatch.operators.delta import not_processed
from presswatch.session import staged
from presswatch.sources.tables import append_table, read_table


def with_watermark(df: DataFrame, ts: str = "Timestamp", delay: str = "3 days") -> DataFrame:
    """Event time for stream state; zone-less times are read as UTC."""
    return df.withColumn(ts, df[ts].cast("timestamp")).withWatermark(ts, delay)


def first_arrivals(df: DataFrame, key: str = "URL", ts: str = "Timestamp", delay: str = "3 days") -> DataFrame:
    """The first arrival of each URL; state is dropped after the delay, as retention does with the table."""
    return with_watermark(df, ts, delay).dropDuplicatesWithinWatermark([key])


def append_new(table: str, schema) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: only URLs that the table lacks are appended, so a batch that is
    run again after a failure adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = read_table(spark, table, schema)
        append_table(staged(not_processed(distinct_articles(batch), stored), "append"), table)

    return write


def start_append(df: DataFrame, table: str, schema, checkpoint: str) -> StreamingQuery:
    """Process everything that has landed, then stop."""
    return (
        df.writeStream.foreachBatch(append_new(table, schema))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
