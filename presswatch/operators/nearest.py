"""Nearest topics and average linkage from cluster sums, without a stored table of pairs.

A topic's vector is made unit length; a cluster is its size and the sum S of its members' unit vectors. The
mean cosine distance between the members of two clusters is ``1 - S_A·S_B / (|A| |B|)``, so average linkage
needs only the sums. Each round, the blocked product of the sums (``distance.pair_dots``) gives every cluster
its nearest other cluster, and only those K rows are kept; pairs that are each other's nearest merge (average
linkage is reducible, so merging all reciprocal pairs at once gives the tree of one merge at a time); the sums
of a merged cluster are added term by term. Per round, the sums (a row per cluster and term) and K rows of
nearest clusters are written; no table of all pairs is ever stored.

Ward linkage over cosine distances has no such form (its update squares a distance that is itself a squared
length), so it stays on the distance table of ``hierarchy.linkage``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.operators.distance import pair_dots
from presswatch.operators.hierarchy import _merges
from presswatch.session import staged

TIE_DIGITS = 9  # distances equal to this many digits are ties, decided by the smaller pair of clusters


def unit_vectors(scores: DataFrame) -> DataFrame:
    """``(slot, term, value)``: each topic's scores divided by their length."""
    norms = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
    return scores.join(norms, "topic").select(
        F.col("topic").cast("int").alias("slot"), "term", (F.col("score") / F.col("norm")).alias("value"))


def nearest_clusters(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(slot, best)``: each cluster's nearest other one, ``best`` = (d, a, b) with ``a < b`` the pair.

    ``d`` is the mean cosine distance of the members; ties (to ``TIE_DIGITS`` digits) go by the smaller pair.
    """
    dots, _ = pair_dots(sums.select(F.col("slot").alias("topic"), "term", F.col("value").alias("score")))
    n = sizes.select("slot", "size")
    pairs = (dots.join(n.select(F.col("slot").alias("ta"), F.col("size").alias("na")), "ta")
             .join(n.select(F.col("slot").alias("tb"), F.col("size").alias("nb")), "tb")
             .select(F.col("ta").alias("a"), F.col("tb").alias("b"),
                     F.greatest(F.lit(0.0), 1 - F.col("dot") / (F.col("na") * F.col("nb"))).alias("d")))
    tie = F.round("d", TIE_DIGITS)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("slot"), F.struct(tie.alias("key"), "a", "b", "d").alias("s"))
    best = ends.groupBy("slot").agg(F.min("s").alias("s"))
    return best.select("slot", F.struct(F.col("s.d").alias("d"), F.col("s.a").alias("a"),
                                        F.col("s.b").alias("b")).alias("best"))


def nearest_topics(scores: DataFrame) -> DataFrame:
    """``(topic, nearest, dist)``: the topic of least cosine distance to each topic (K rows)."""
    unit = staged(unit_vectors(scores), "unit")
    sizes = unit.select("slot").distinct().withColumn("size", F.lit(1).cast("long"))
    best = nearest_clusters(unit, sizes)
    return best.select(F.col("slot").alias("topic"),
                       F.when(F.col("best.a") == F.col("slot"), F.col("best.b")).otherwise(F.col("best.a"))
                       .alias("nearest"), F.col("best.d").alias("dist"))


def average_linkage(scores: DataFrame) -> DataFrame:
    """Merges of the average-linkage tree, in the columns of ``hierarchy.linkage``, from cluster sums."""
    sums = staged(unit_vectors(scores), "sums")
    clusters = staged(sums.select("slot").distinct().select(
        "slot", F.lit(1).cast("long").alias("size"), F.array("slot").alias("topics")), "clusters")
    left = clusters.count()
    log = []
    while left > 1:
        best = nearest_clusters(sums, clusters)
        chosen = best.groupBy("best").agg(F.count(F.lit(1)).alias("votes")).filter("votes = 2")
        moves = chosen.select(F.explode(F.array("best.a", "best.b")).alias("slot"), F.col("best.a").alias("to"),
                              F.col("best.d").alias("step"))
        members = staged(clusters.join(moves, "slot", "left").select(
            "slot", "size", "topics", F.coalesce("to", "slot").alias("to"), "step"), "members")
        merged = members.filter(F.col("step").isNotNull()).count() // 2
        if not merged:
            raise ValueError("no pair of clusters could merge")
        left -= merged
        log.append(_merges(members))
        if left > 1:
            sums = staged(sums.join(members.select("slot", "to"), "slot").groupBy(F.col("to").alias("slot"), "term")
                          .agg(F.sum("value").alias("value")), "sums")
            clusters = staged(members.groupBy(F.col("to").alias("slot")).agg(
                F.sum("size").alias("size"), F.array_sort(F.flatten(F.collect_list("topics"))).alias("topics")),
                "clusters")
    if log:
        return reduce(lambda a, b: a.unionByName(b), log)
    none = "CAST(NULL AS {0}) AS {1}".format
    return clusters.filter(F.lit(False)).selectExpr(
        none("int", "left"), none("bigint", "left_size"), none("array<int>", "left_topics"),
        none("int", "right"), none("bigint", "right_size"), none("array<int>", "right_topics"),
        none("double", "dist"))
