"""A saved topic model: fit once, then give unseen documents a topic without fitting again.

The artefact is a folder on storage that every executor reaches:

- ``embedder/``: the fitted text pipeline (hashed TF-IDF of unit length), when topics come from texts;
- ``reducer/``: the fitted projection (unit length, then principal components), when no matrix is given;
- ``settings/``: one row with the cell widths, the fixed projection matrix if any and the column names;
- ``cells/``: the topic of every cell that held a row at fit time (-1 for cells of outliers).

``assign_topics`` embeds and projects new rows exactly as the fit did and reads their cell's topic. A cell
that held no row at fit time is searched in rings around it (Chebyshev distance 1, then 2, up to ``rings``):
the nearest ring with a cell of a topic wins, within it the cell of the least squared offset, then the least
topic; with none, -1. The search runs once per distinct unseen cell, never per row, and only a table of
cells meets the rows: a cell that a third of all rows share is one lookup.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from presswatch.config import DEFAULTS, Settings, cluster_tier
from presswatch.operators import density, embedding
from presswatch.operators.skew import checked_join
from presswatch.session import hadoop_path, staged

SETTINGS = StructType([
    StructField("widths", ArrayType(DoubleType()), False),
    StructField("matrix", ArrayType(ArrayType(DoubleType())), True),
    StructField("text", StringType(), True),
    StructField("vector", StringType(), True),
    StructField("rings", IntegerType(), False),
])


@dataclass(frozen=True)
class SavedTopics:
    """A loaded artefact; ``cells`` reads the saved table."""

    path: str
    widths: list[float]
    cells: DataFrame
    embedder: PipelineModel | None = None
    reducer: PipelineModel | None = None
    matrix: list[list[float]] | None = None
    text: str | None = None
    vector: str | None = None
    rings: int = 1


def fit_reducer(df: DataFrame, vector: str, size: int) -> PipelineModel:
    """Unit length, then ``size`` principal components (fewer for narrower vectors)."""
    width = df.select(F.size(vector)).filter(F.col(vector).isNotNull()).first()
    k = min(size, width[0]) if width else size
    stages = [Normalizer(inputCol="_vector", outputCol="_scaled", p=2.0),
              PCA(k=k, inputCol="_scaled", outputCol="_pca")]
    return Pipeline(stages=stages).fit(_as_vector(df, vector))


def _as_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_vector", array_to_vector(F.col(vector).cast("array<double>")))


def _points(df: DataFrame, saved: SavedTopics, name: str) -> DataFrame:
    """``df`` with the reduced vector ``name``, made as at fit time."""
    if saved.text is not None:
        rows = embedding.with_embedding(df, saved.embedder, saved.text, "_embedding")
    else:
        rows = df.withColumn("_embedding", F.col(saved.vector))
    if saved.matrix is not None:
        return embedding.projected(rows, saved.matrix, "_embedding", name).drop("_embedding")
    out = saved.reducer.transform(_as_vector(rows, "_embedding"))
    return out.withColumn(name, vector_to_array("_pca")).drop("_vector", "_scaled", "_pca", "_embedding")


def fit_topic_model(df: DataFrame, key: str, path: str, text: str | None = None, vector: str | None = None,
                    matrix: list[list[float]] | None = None, widths: list[float] | None = None,
                    min_size: int | None = None, min_samples: int | None = None, rings: int = 1,
                    settings: Settings = DEFAULTS) -> tuple[DataFrame, SavedTopics]:
    """Fit on ``df`` (one of ``text`` or ``vector``), save the artefact under ``path``; returns
    (key, reduced, topic) of the rows and the loaded model.

    ``key`` tells rows apart for the clustering; widths default to Scott's rule, sizes to the cluster tier.
    """
    if (text is None) == (vector is None):
        raise ValueError("give exactly one of text and vector")
    spark = df.sparkSession
    embedder = embedding.fit_embedding(df, text, settings.embedding_size) if text is not None else None
    reducer = None
    if matrix is None:
        vectors = (embedding.with_embedding(df, embedder, text, "_embedding") if text is not None
                   else df.withColumn("_embedding", F.col(vector)))
        reducer = fit_reducer(vectors, "_embedding", settings.reduced_size)
    draft = SavedTopics(path, [], spark.range(0).select(), embedder, reducer, matrix, text, vector, rings)
    points = staged(_points(df.select(key, *[c for c in (text, vector) if c]), draft, "reduced")
                    .select(key, "reduced"), "reduced")
    dims = len(matrix) if matrix is not None else reducer.stages[-1].getK()
    widths = widths or density.scott_widths(points, "reduced", dims)
    tier = cluster_tier(points.count())
    topics = staged(density.density_topics(points, key, "reduced", widths, min_size or tier, min_samples or tier),
                    "topics")
    cells = points.join(topics, key).groupBy(density.cell_of(F.col("reduced"), widths).alias("cell")).agg(
        F.min("topic").alias("topic"))
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(list(map(float, widths)), matrix, text, vector, rings)], SETTINGS).coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/settings")
    if embedder is not None:
        embedder.write().overwrite().save(f"{path}/embedder")
    if reducer is not None:
        reducer.write().overwrite().save(f"{path}/reducer")
    return points.join(topics, key), load_topic_model(spark, path)


def load_topic_model(spark: SparkSession, path: str) -> SavedTopics:
    """The artefact under ``path``; only its one settings row reaches the driver."""
    row = spark.read.schema(SETTINGS).parquet(f"{path}/settings").first()
    target, fs = hadoop_path(spark, f"{path}/reducer")
    return SavedTopics(
        path=path, widths=list(row.widths), cells=spark.read.parquet(f"{path}/cells"),
        embedder=PipelineModel.load(f"{path}/embedder") if row.text is not None else None,
        reducer=PipelineModel.load(f"{path}/reducer") if fs.exists(target) else None,
        matrix=[list(r) for r in row.matrix] if row.matrix is not None else None,
        text=row.text, vector=row.vector, rings=row.rings)


def model_exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop_path(spark, f"{path}/settings")
    return fs.exists(target)


def ring_offsets(dims: int, rings: int) -> list[tuple[int, int, list[int]]]:
    """(ring, squared length, offset) of every offset at Chebyshev distance 1 to ``rings``."""
    out = []
    for offset in itertools.product(range(-rings, rings + 1), repeat=dims):
        ring = max(abs(x) for x in offset)
        if ring:
            out.append((ring, sum(x * x for x in offset), list(offset)))
    return out


def _ring_topics(unseen: DataFrame, cells: DataFrame, dims: int, rings: int) -> DataFrame:
    """(cell, topic) of each unseen cell that has a topic cell in its rings."""
    offsets = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(d).alias("d2"),
                                 F.array(*[F.lit(x).cast("long") for x in o]).alias("o"))
                        for r, d, o in ring_offsets(dims, rings)])
    around = unseen.select("cell", F.explode(offsets).alias("step")).select(
        "cell", "step.ring", "step.d2",
        F.zip_with("cell", "step.o", lambda c, o: c + o).alias("near"))
    topics = cells.filter(F.col("topic") >= 0).select(F.col("cell").alias("near"), "topic")
    met = around.join(topics, "near")
    best = met.groupBy("cell").agg(F.min(F.struct("ring", "d2", "topic")).alias("best"))
    return best.select("cell", F.col("best.topic").alias("topic"))


def assign_topics(saved: SavedTopics, df: DataFrame, name: str = "topic", reduced: str | None = None) -> DataFrame:
    """``df`` with its topic from the saved model (see the module text); other columns stay.

    ``reduced`` also keeps the reduced vector under that name (the maps of the topic report read it).
    """
    cell_col, point = "_assign_cell", reduced or "_assign_reduced"
    rows = _points(df, saved, point).withColumn(cell_col, density.cell_of(F.col(point), saved.widths))
    if reduced is None:
        rows = rows.drop(point)
    distinct = rows.select(F.col(cell_col).alias("cell")).distinct()
    unseen = staged(distinct.join(saved.cells, "cell", "left_anti"), "unseen-cells")
    found = _ring_topics(unseen, saved.cells, len(saved.widths), saved.rings)
    lookup = staged(saved.cells.unionByName(found), "cell-lookup").withColumnRenamed("cell", cell_col)
    # A hot cell is spread over tasks by the other columns of its rows.
    joined = checked_join(rows.drop(name), lookup.withColumnRenamed("topic", name), [cell_col],
                          spread=[c for c in df.columns if c != name] or [cell_col], how="left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(-1))).drop(cell_col)
