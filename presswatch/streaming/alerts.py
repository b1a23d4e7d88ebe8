"""Alert counts kept current on a stream. The window functions are those of the batch module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presswatch.operators.windows import sliding_counts, tumbling_counts
from presswatch.session import hadoop_path, staged
from presswatch.streaming.ingest import with_watermark


def sliding_alerts(df: DataFrame, key: str = "AlertFlag", ts: str = "Timestamp", delay: str = "3 days") -> DataFrame:
    """Five-hour counts per colour, every hour."""
    return sliding_counts(with_watermark(df, ts, delay), key, ts)


def hourly_arrivals(df: DataFrame, key: str = "NewsCategory", ts: str = "Timestamp", delay: str = "3 days"
                    ) -> DataFrame:
    return tumbling_counts(with_watermark(df, ts, delay), key, ts)


def merge_windows(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for update mode: the changed (window, key) counts replace their rows in the
    day partitions of the table at ``path``. Only the days the batch touches are read and rewritten; files of
    other days stay as they are. Counts in update mode are totals, so a batch run again writes the same rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = staged(batch.withColumn("day", F.to_date("win_start")), "changed")
        target, fs = hadoop_path(spark, path)
        merged = changed
        if fs.exists(target):
            days = changed.select("day").distinct()
            old = spark.read.schema(changed.schema).parquet(path).join(days, "day", "left_semi")
            same = (old["win_start"] == changed["win_start"]) & old[key].eqNullSafe(changed[key])
            merged = old.join(changed.select("win_start", key), same, "left_anti").unionByName(changed)
        staged(merged, "merged").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("day").parquet(path)

    return write


def start_counts(counts: DataFrame, path: str, checkpoint: str, mode: str = "complete",
                 key: str | None = None) -> StreamingQuery:
    """Write the counts of each batch: in complete mode the table is replaced, in append mode extended, in
    update mode the changed windows are merged into their days (``key`` names the key column)."""
    if mode == "update":
        return (
            counts.writeStream.outputMode("update").foreachBatch(merge_windows(path, key))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )

    def write(batch: DataFrame, batch_id: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
