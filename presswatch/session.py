"""Session defaults and the shared work folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "presswatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: zone-less timestamps are UTC everywhere in this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_base(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _LOCAL_BASE:
        _LOCAL_BASE[app] = tempfile.mkdtemp(prefix="presswatch-")
    return _LOCAL_BASE[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path under the work folder."""
    return f"{work_base(spark)}/presswatch/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the work folder and continue from the files.

    Cuts lineage between rounds, survives the loss of executors, and gives the optimizer real
    sizes: a later join broadcasts the table only when its files are below the session threshold.
    """
    path = _written(df, label)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_apart(df: DataFrame, label: str, by: str) -> dict[str, DataFrame]:
    """As ``staged``, with a table of its own for each value of ``by``: each is read and removed without the others."""
    path, spark = _written(df, label, by), df.sparkSession
    target, fs = hadoop_path(spark, path)
    folders = [s.getPath().getName() for s in fs.listStatus(target) if s.isDirectory()]
    return {name.split("=", 1)[1]: spark.read.schema(df.drop(by).schema).parquet(f"{path}/{name}") for name in folders}


def _written(df: DataFrame, label: str, *by: str) -> str:
    spark = df.sparkSession
    path = work_path(spark, label)
    with no_shuffles_left(spark):
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    if (of_job := _STAGED.get()) is not None:
        of_job.append(path)
    return path


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write in this block go at its end, not when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def released(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        base = f"{hadoop_path(spark, work_base(spark))[0].toUri().getPath()}/presswatch/"
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            target, fs = hadoop_path(spark, folder)
            if not target.toUri().getPath().startswith(base):
                raise ValueError(f"{folder} is not in the work folder")
            fs.delete(target, True)


def hadoop_path(spark: SparkSession, path: str):
    """A path with its file system, whatever storage it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def work_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside the block at its end: a periodic job leaves only its results.

    Each block (and thread) has a list of its own, so jobs of one driver do not touch each other's tables.
    """
    own: list[str] = []
    token = _STAGED.set(own)
    try:
        yield
    finally:
        _STAGED.reset(token)
        for path in own:
            target, fs = hadoop_path(spark, path)
            fs.delete(target, True)
