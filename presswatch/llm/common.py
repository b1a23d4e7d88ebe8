"""Small DataFrame helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswatch.session import use_utc


BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> SparkSession:
    """Bound an Arrow batch by bytes, not rows alone: texts and sets of shingles may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return use_utc(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has (names are compared without case, as Spark does)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def bitmap_of(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of the low bits of 64-bit keys; 2^bits / 64 numbers at most reach the driver, whatever the input."""
    cells = (keys.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("bit")).distinct()
             .groupBy(F.shiftright("bit", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("set").to_numpy().view(np.uint64)
    return out
