"""Density clusters with outliers, sized for any number of rows.

Rows fall into the cells of a regular grid over the reduced vectors. A cell is *core* when it and
the cells that share a face with it hold at least ``min_samples`` rows. Core cells that share a face
form one cluster; an occupied cell next to a core cell joins the smallest such cluster; all other
rows are outliers (-1), and so are clusters with fewer than ``min_size`` rows. Work is one
aggregation over the rows and then a graph with at most two edges per cell and dimension: no pair of
rows is ever formed, and any number of rows in one cell is one count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.operators.skew import checked_join, lookup_join, number_rows
from presswatch.session import staged


def scott_widths(df: DataFrame, vector: str, size: int) -> list[float]:
    """Cell width per dimension by Scott's rule, ``3.5 · σ · n^(-1 / (2 + d))``, from one aggregation."""
    stats = df.agg(
        F.count(F.lit(1)), *[F.stddev_pop(F.get(F.col(vector), F.lit(i))) for i in range(size)]).first()
    n = max(stats[0], 1)
    return [3.5 * (s or 0.0) * n ** (-1.0 / (2 + size)) or 1.0 for s in stats[1:]]


def cell_of(vector: Column, widths: Sequence[float]) -> Column:
    return F.array(*[F.floor(F.get(vector, F.lit(i)) / F.lit(float(w))) for i, w in enumerate(widths)])


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, label)``: the smallest id of each component, for ``edges(u, v)`` given in both directions.

    Each round a node takes the smallest of its label, its neighbours' labels and its label's label,
    all from the table of the round before. The rounds are written tables; labels only fall, so the loop ends,
    when no label changes. A label shared by a third of all nodes is looked up through the salted join.
    """
    edges = staged(edges.select("u", "v"), "edges")
    labels = staged(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["v"] == labels["id"]).groupBy("u").agg(F.min("label").alias("near"))
        used = labels.select("label").distinct()
        hop = used.join(
            labels.select(F.col("id").alias("root"), F.col("label").alias("jump")), F.col("label") == F.col("root")
        ).select("label", "jump")
        jumped = lookup_join(labels, hop, ["label"], spread=["id"])
        moved = staged(
            jumped.join(near, jumped["id"] == near["u"], "left").select(
                "id", F.col("label").alias("before"), F.least("jump", F.coalesce("near", "jump")).alias("label")),
            "labels")
        labels = moved.select("id", "label")
        if moved.filter(F.col("label") != F.col("before")).isEmpty():
            return labels


def _faces(cells: DataFrame, size: int) -> DataFrame:
    """Occupied neighbours: ``(u, v, n_v)`` in both directions, by an equality join on shifted cells."""
    def one_ahead(axis: int) -> Column:
        return F.transform(F.col("cell"), lambda x, i: x + F.when(i == axis, 1).otherwise(0))

    shifted = [one_ahead(axis) for axis in range(size)]
    ahead = cells.select(F.col("id").alias("u"), F.col("n").alias("n_u"), F.explode(F.array(*shifted)).alias("cell"))
    met = ahead.join(cells.select("cell", F.col("id").alias("v"), F.col("n").alias("n_v")), "cell")
    return met.select("u", "v", "n_v").unionByName(
        met.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n_u").alias("n_v")))


def density_topics(df: DataFrame, key: str, vector: str, widths: Sequence[float], min_size: int,
                   min_samples: int) -> DataFrame:
    """``(key, topic)``: topics numbered by size from 0, equal sizes by their smallest key; -1 = outlier."""
    size = len(widths)
    placed = df.select(F.col(key), cell_of(F.col(vector), widths).alias("cell"))
    # A cell has a number of its own, in the order of its first key: keys may repeat.
    counted = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
    cells = staged(number_rows(counted, [F.col("first_key").asc(), F.col("cell").asc()], "id"), "cells")
    faces = staged(_faces(cells, size), "faces")
    around = faces.groupBy("u").agg(F.sum("n_v").alias("around"))
    core = staged(
        cells.join(around, cells["id"] == around["u"], "left")
        .filter(F.col("n") + F.coalesce("around", F.lit(0)) >= min_samples).select("id"), "core")

    to_core = faces.join(core.select(F.col("id").alias("v")), "v", "left_semi")
    inner = to_core.join(core.select(F.col("id").alias("u")), "u", "left_semi")
    labels = connected_components(core, inner)
    border = (
        to_core.join(core.select(F.col("id").alias("u")), "u", "left_anti")
        .join(labels.withColumnRenamed("id", "v"), "v")
        .groupBy("u").agg(F.min("label").alias("label")).withColumnRenamed("u", "id")
    )
    labelled = labels.unionByName(border).join(cells, "id").select("id", "cell", "n", "label")
    clusters = labelled.groupBy("label").agg(
        F.sum("n").alias("rows"), F.min("id").alias("first")).filter(F.col("rows") >= min_size)
    numbered = number_rows(clusters, [F.col("rows").desc(), F.col("first").asc()], "topic").select(
        "label", F.col("topic").cast("int").alias("topic"))
    cell_topics = staged(
        lookup_join(labelled, numbered, ["label"], spread=["id"]).select("cell", "topic"), "cell-topics")
    return checked_join(placed, cell_topics, ["cell"], spread=[key], how="left").select(
        key, F.coalesce("topic", F.lit(-1)).alias("topic"))
