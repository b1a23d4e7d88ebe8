"""Pairwise topic distances.

The result is the full upper triangle of the topic matrix, as the hierarchy needs it. It is computed
as a blocked matrix product: topics are hashed into blocks, terms into shards, and each (block,
block, shard) task multiplies two small dense matrices. No join pairs rows inside a term, so a word
that every topic uses costs no more than a rare one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TOPICS = 128
ROWS_PER_SHARD = 50_000  # bounds a task's matrix to about 256 topics × 50,000 terms
METRICS = ("cosine", "euclidean")


def _block_products(group: pd.DataFrame) -> pd.DataFrame:
    """Partial dot products of one block pair over one term shard, upper triangle only."""
    topics, row = np.unique(group["topic"].to_numpy(), return_inverse=True)
    _, column = np.unique(group["term"].fillna("").to_numpy(dtype=str), return_inverse=True)
    matrix = np.zeros((len(topics), column.max() + 1))
    np.add.at(matrix, (row, column), group["score"].to_numpy())
    block = np.empty(len(topics), dtype=np.int64)
    block[row] = group["block"].to_numpy()
    i, j = np.triu_indices(len(topics), k=1)
    first, second = int(group["first"].iloc[0]), int(group["second"].iloc[0])
    wanted = ((block[i] == first) & (block[j] == second)) | ((block[i] == second) & (block[j] == first))
    i, j = i[wanted], j[wanted]
    return pd.DataFrame({"ta": topics[i], "tb": topics[j], "dot": (matrix @ matrix.T)[i, j]})


def pair_dots(vectors: DataFrame, block_topics: int = BLOCK_TOPICS) -> tuple[DataFrame, DataFrame]:
    """``(ta, tb, dot)`` for all ``ta < tb`` and ``(topic, sq)`` of a long vector table ``(topic, term, score)``."""
    rows_of = vectors.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    n_topics, n_rows, largest = rows_of.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = max(1, math.ceil(n_topics / block_topics))
    shards = max(1, math.ceil((largest + 2 * n_rows / blocks) / ROWS_PER_SHARD))

    # One empty entry per topic makes each pair appear, also the pairs without a common term.
    norms = vectors.groupBy("topic").agg(F.sum(F.col("score") * F.col("score")).alias("sq"))
    anchors = norms.select("topic", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("score"))
    rows = vectors.select("topic", "term", F.col("score").cast("double").alias("score")).unionByName(anchors)
    keyed = rows.select(
        "topic", "term", "score",
        F.pmod(F.xxhash64("topic"), F.lit(blocks)).cast("int").alias("block"),
        F.when(F.col("term").isNull(), 0).otherwise(F.pmod(F.hash("term"), F.lit(shards))).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    keyed = keyed.select(
        "topic", "term", "score", "block", "shard",
        F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second"))
    products = keyed.groupBy("first", "second", "shard").applyInPandas(
        _block_products, "ta int, tb int, dot double")
    return products.groupBy("ta", "tb").agg(F.sum("dot").alias("dot")), norms


def topic_distance(vectors: DataFrame, metric: str = "cosine", block_topics: int = BLOCK_TOPICS) -> DataFrame:
    """``(ta, tb, dist)`` for all ``ta < tb`` of a long vector table ``(topic, term, score)``."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    dots, norms = pair_dots(vectors, block_topics)
    pairs = (
        dots.join(norms.select(F.col("topic").alias("ta"), F.col("sq").alias("sa")), "ta")
        .join(norms.select(F.col("topic").alias("tb"), F.col("sq").alias("sb")), "tb")
    )
    if metric == "cosine":
        dist = F.lit(1.0) - F.col("dot") / F.sqrt(F.col("sa") * F.col("sb"))
    else:
        dist = F.sqrt(F.greatest(F.lit(0.0), F.col("sa") + F.col("sb") - 2 * F.col("dot")))
    return pairs.select("ta", "tb", F.greatest(F.lit(0.0), dist).alias("dist"))


def distance_problems(distances: DataFrame, topics: DataFrame) -> DataFrame:
    """Counts of what makes a distance table invalid: missing pairs, wrong order, null, NaN or negative values."""
    n = topics.select(F.count_distinct("topic")).scalar()
    pairs = F.count(F.lit(1))
    return distances.agg(
        (n * (n - 1) / 2 - pairs).cast("long").alias("missing_pairs"),
        F.count_if(F.col("ta") >= F.col("tb")).alias("misordered"),
        F.count_if(F.col("dist").isNull() | F.isnan("dist")).alias("undefined"),
        F.count_if(F.col("dist") < 0).alias("negative"),
    )


def require_valid(distances: DataFrame, topics: DataFrame) -> None:
    """Raise when the distances cannot be clustered."""
    problems = distance_problems(distances, topics).first().asDict()
    if any(problems.values()):
        raise ValueError(f"invalid topic distances: {problems}")
