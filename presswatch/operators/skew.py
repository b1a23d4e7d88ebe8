"""Helpers for keys that may hold a large share of all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswatch.session import hadoop_path, staged

BROADCAST_ROWS = 50_000
SALTS = 8
TASK_BYTES = 4 << 20
SLICE_BYTES = 256 << 20


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; at most ``max_rows + 1`` constants are read."""
    return len(df.select(F.lit(1).alias("x")).take(max_rows + 1)) <= max_rows


def _file_bytes(df: DataFrame) -> int:
    spark = df.sparkSession
    size = 0
    for file in df.inputFiles():
        target, fs = hadoop_path(spark, file)
        size += fs.getFileStatus(target).getLen()
    return size


def in_slices(df: DataFrame, key: str) -> list[DataFrame]:
    """The rows of a table by hash of ``key``, as many slices as keep one at about ``SLICE_BYTES`` of the files it is
    read from. Work done slice by slice has the shuffle files of one on disk; each reads the table again."""
    n = max(1, math.ceil(_file_bytes(df) / SLICE_BYTES))
    return [df] if n == 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def spread_out(df: DataFrame, key: str, slices: int = 1) -> DataFrame:
    """Place the rows of a text table by ``key``, on as many tasks as keep one at about ``TASK_BYTES`` of the
    files it is read from, so that what a task holds of words or sorted texts does not grow with the table.
    Joins and groupings on ``key`` use the same placement. A scan with that many splits stays as it is, if
    ``df`` is not one of several ``slices`` of its files' rows."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(_file_bytes(df) / TASK_BYTES / slices))
    return df.repartition(tasks, key) if slices > 1 or df.rdd.getNumPartitions() < tasks else df


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join a table with few rows per key to one where a single key may hold a third of all rows.

    ``spread`` columns of the big side choose one of ``salts`` sub-keys, the small side is repeated
    per sub-key, so a hot key is worked on by ``salts`` tasks. All rows take part.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: Sequence[Column], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers over a global order without sorting the table in one task.

    Rows are range-partitioned, sorted and numbered as they are written, so they move once; the window
    that adds the ranges up sees one row per partition.
    """
    inside = (1 << 33) - 1  # an id is the partition's number and, in the low 33 bits, the row's place in it
    ranged = staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()),
        "numbered").withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .withColumn(name, (F.col("_before") + F.col("_id").bitwiseAND(F.lit(inside)) + F.lit(start)).cast("long"))
        .drop("_part", "_before", "_id")
    )


def checked_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str],
                 how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` when a row check allows it, else the salted shuffle join."""
    if fits(small, max_rows):
        return big.join(F.broadcast(small), list(on), how)
    return lookup_join(big, small, on, spread, how)


def frequent_join(big: DataFrame, small: DataFrame, on: str, weight: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of rows with a table of their keys, which says in ``weight`` how many of the rows a key has.

    ``small`` is broadcast when a row check allows it. Otherwise its heaviest keys are, by powers of two, and only the
    rows of the others are shuffled, with one copy of these: none of them has more than a few ``max_rows``-ths of all.
    """
    if fits(small, max_rows):
        return big.join(F.broadcast(small), on)
    power = F.floor(F.log2(weight)).cast("int")
    least, taken = 64, 0
    for at, n in sorted(((r[0], r[1]) for r in small.groupBy(power).count().collect()), reverse=True):  # 63 rows at most
        taken += n
        if taken > max_rows:
            break
        least = at
    heavy, light = small.filter(power >= least), small.filter(power < least)
    return big.join(F.broadcast(heavy), on).unionByName(
        big.join(F.broadcast(heavy.select(on)), on, "left_anti").join(light, on))
