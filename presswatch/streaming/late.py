"""Rows behind the watermark as a side output of a stream: counted, archived, never lost silently.

Spark's stateful operators drop rows older than the watermark without a trace. ``late_rows_writer`` is a
``foreachBatch`` function that applies the same rule itself: the watermark of micro-batch N is the largest event
time of batches 0 to N-1 minus ``delay`` (Spark's rule: it advances at the end of a batch). Rows of batch N before
it are archived under ``late/batch=N``; the others go on to ``sink``. The largest event time of each batch is kept
under ``marks/batch=N``. Both are written per batch id with overwrite, so a batch run again after a failure
replaces its own output and adds nothing; only one number (the largest earlier event time) reaches the driver.
Rows without an event time are never late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.session import hadoop_path, staged


def watermark_before(spark, marks: str, batch_id: int):
    """The largest event time of the batches before ``batch_id``, or None."""
    target, fs = hadoop_path(spark, marks)
    if not fs.exists(target):
        return None
    return spark.read.parquet(marks).filter(F.col("batch") < batch_id).agg(F.max("max_ts")).first()[0]


def late_rows_writer(ts: str, delay: str, marks: str, late: str,
                     sink: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: late rows to ``late``, the rest to ``sink``; ``delay`` is a SQL interval."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = watermark_before(spark, marks, batch_id)
        if before is None:
            behind = F.lit(False)
        else:
            behind = F.coalesce(F.col(ts) < F.lit(before) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows = staged(batch.withColumn("_late", behind), "batch")
        rows.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        if sink is not None:
            sink(rows.filter(~F.col("_late")).drop("_late"), batch_id)
        rows.agg(F.max(ts).alias("max_ts")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return write


def late_counts(spark, late: str) -> DataFrame:
    """Late rows per batch from the archive."""
    return spark.read.parquet(late).groupBy("batch").agg(F.count(F.lit(1)).alias("late_rows"))
