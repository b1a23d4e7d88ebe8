"""Topic hierarchy by agglomerative linkage in parallel rounds.

All linkages offered are reducible: merging every pair of reciprocal nearest neighbours at once gives
the same tree as merging one closest pair at a time. Each round is a fixed number of joins and
aggregations over the distance table, written to the work folder before the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.operators.skew import lookup_join, number_rows
from presswatch.operators.topic_terms import joined_terms, term_idf, top_terms, topic_names
from presswatch.session import staged

METHODS = ("ward", "average", "complete")
ORDER_DIGITS = 12


def _merged(method: str, d: str, own: str, fixed: str, step: str) -> Column:
    """Distance of a merged pair to a fixed cluster; with a single member it is that member's distance."""
    d, own, fixed, step = F.col(d), F.col(own), F.col(fixed), F.col(step)
    if method == "ward":
        total = F.sum((fixed + own) * d * d) - F.max(fixed) * F.max(step * step)
        merged = F.sqrt(F.greatest(F.lit(0.0), total / (F.max(fixed) + F.sum(own))))
    elif method == "average":
        merged = F.sum(own * d) / F.sum(own)
    else:
        merged = F.max(d)
    return F.when(F.count(F.lit(1)) == 1, F.max(d)).otherwise(merged)


def _next_distances(dist: DataFrame, members: DataFrame, method: str) -> DataFrame:
    """Distances between the clusters after a round, first merging the one side, then the other."""
    sides = {
        side: members.select(F.col("slot").alias(side), F.col("size").alias(f"{side}_size"),
                             F.col("to").alias(f"{side}_to"), F.col("step").alias(f"{side}_step"))
        for side in ("u", "v")
    }
    both = dist.select(F.col("a").alias("u"), F.col("b").alias("v"), "d").unionByName(
        dist.select(F.col("b").alias("u"), F.col("a").alias("v"), "d"))
    sided = both.join(sides["u"], "u").join(sides["v"], "v").filter(F.col("u_to") < F.col("v_to"))
    half = sided.groupBy("u_to", "v_to", "v", "v_size", "v_step").agg(
        _merged(method, "d", "u_size", "v_size", "u_step").alias("d"), F.sum("u_size").alias("pair_size"))
    full = half.groupBy("u_to", "v_to").agg(_merged(method, "d", "v_size", "pair_size", "v_step").alias("d"))
    return full.select(F.col("u_to").alias("a"), F.col("v_to").alias("b"), "d")


def _members(clusters: DataFrame, dist: DataFrame) -> DataFrame:
    """Clusters with where they go this round: ``to`` and, for a merged one, the distance ``step``.

    A pair merges when it is the closest pair of both its clusters.
    """
    best = F.min(F.struct("d", "a", "b")).alias("best")
    nearest = dist.withColumn("c", F.explode(F.array("a", "b"))).groupBy("c").agg(best)
    chosen = nearest.groupBy("best").agg(F.count(F.lit(1)).alias("votes")).filter("votes = 2")
    moves = chosen.select(
        F.explode(F.array("best.a", "best.b")).alias("slot"), F.col("best.a").alias("to"),
        F.col("best.d").alias("step"))
    return clusters.join(moves, "slot", "left").select(
        "slot", "size", "topics", F.coalesce("to", "slot").alias("to"), "step")


def _merges(members: DataFrame) -> DataFrame:
    """The round's merges, left being the cluster with the smaller topic."""
    node = F.struct("slot", "size", "topics")
    first, second = F.when(F.col("slot") == F.col("to"), node), F.when(F.col("slot") != F.col("to"), node)
    pairs = members.filter(F.col("step").isNotNull()).groupBy("to").agg(
        F.max(first).alias("l"), F.max(second).alias("r"), F.max("step").alias("dist"))
    return pairs.select(
        F.col("l.slot").alias("left"), F.col("l.size").alias("left_size"), F.col("l.topics").alias("left_topics"),
        F.col("r.slot").alias("right"), F.col("r.size").alias("right_size"), F.col("r.topics").alias("right_topics"),
        "dist")


def linkage(topics: DataFrame, distances: DataFrame, method: str = "ward") -> DataFrame:
    """Merges of the tree: ``(left, left_size, left_topics, right, right_size, right_topics, dist)``.

    A cluster is named by its smallest topic and its size, which no other node of the tree shares.
    Equal distances go by the smaller pair of clusters, so every round merges at least one pair.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    clusters = topics.select("topic").distinct().select(
        F.col("topic").cast("int").alias("slot"), F.lit(1).cast("long").alias("size"),
        F.array(F.col("topic").cast("int")).alias("topics"))
    left = clusters.count()
    dist = staged(distances.select(
        F.col("ta").cast("int").alias("a"), F.col("tb").cast("int").alias("b"), F.col("dist").alias("d")), "dist")
    log = []
    while left > 1:
        members = staged(_members(clusters, dist), "members")
        merged = members.filter(F.col("step").isNotNull()).count() // 2
        if not merged:
            raise ValueError("the distance table lacks pairs")
        left -= merged
        log.append(_merges(members))
        if left > 1:
            dist = staged(_next_distances(dist, members, method), "dist")
            clusters = members.groupBy(F.col("to").alias("slot")).agg(
                F.sum("size").alias("size"),
                F.array_sort(F.flatten(F.collect_list("topics"))).alias("topics"))
    if log:
        return reduce(lambda a, b: a.unionByName(b), log)
    none = "CAST(NULL AS {0}) AS {1}".format
    return clusters.filter(F.lit(False)).selectExpr(
        none("int", "left"), none("bigint", "left_size"), none("array<int>", "left_topics"),
        none("int", "right"), none("bigint", "right_size"), none("array<int>", "right_topics"),
        none("double", "dist"))


def _node_names(nodes: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """``(Parent_ID, Parent_Name)``: best words of the summed counts under the topics' own idf."""
    inside = nodes.select("Parent_ID", F.explode("Topics").alias("topic"))
    summed = lookup_join(counts.select("topic", "term", "n"), inside, ["topic"], spread=["term"]).groupBy(
        "Parent_ID", "term").agg(F.sum("n").alias("n"))
    scored = summed.join(term_idf(counts), "term").withColumn("score", F.col("n") * F.col("idf"))
    return joined_terms(top_terms(scored, words, key=("Parent_ID",)), key=("Parent_ID",), name="Parent_Name")


def hierarchical_topics(counts: DataFrame, merges: DataFrame, scores: DataFrame, words: int = 5) -> DataFrame:
    """Parents numbered after the topics by merge distance, with both children and their names."""
    top = counts.agg(F.max("topic")).first()[0]
    tree = merges.withColumns({
        "Topics": F.array_sort(F.concat("left_topics", "right_topics")),
        "size": F.col("left_size") + F.col("right_size"),
    })
    order = [F.round("dist", ORDER_DIGITS).asc(), F.col("size").asc(), F.col("left").asc()]
    numbered = number_rows(tree, order, "Parent_ID", start=(top or 0) + 1)
    nodes = staged(numbered.withColumn("Parent_ID", F.col("Parent_ID").cast("int")), "nodes")
    names = staged(_node_names(nodes, counts, words), "names")
    leaves = topic_names(scores, words).select(
        F.col("topic").alias("slot"), F.lit(1).cast("long").alias("size"),
        F.col("topic").alias("id"), "name")
    inner = nodes.join(names, "Parent_ID").select(
        F.col("left").alias("slot"), "size", F.col("Parent_ID").alias("id"), F.col("Parent_Name").alias("name"))
    known = staged(leaves.unionByName(inner), "known")

    def child(side: str, title: str) -> DataFrame:
        return known.select(F.col("slot").alias(side), F.col("size").alias(f"{side}_size"),
                            F.col("id").alias(f"Child_{title}_ID"), F.col("name").alias(f"Child_{title}_Name"))

    return (
        nodes.join(names, "Parent_ID")
        .join(child("left", "Left"), ["left", "left_size"], "left")
        .join(child("right", "Right"), ["right", "right_size"], "left")
        .select("Parent_ID", "Parent_Name", "Topics", "Child_Left_ID", "Child_Left_Name",
                "Child_Right_ID", "Child_Right_Name", F.col("dist").alias("Distance"))
    )


def node_annotations(merges: DataFrame, hierarchy: DataFrame, names: DataFrame) -> DataFrame:
    """Names of both children of every merge, read from the parent's own child columns: no join on sets of
    topics. ``merges`` and ``names`` are the tables the hierarchy was built from (kept for callers)."""
    return hierarchy.select(F.col("Topics").alias("topics"), F.col("Child_Left_Name").alias("left_name"),
                            F.col("Child_Right_Name").alias("right_name"), F.col("Distance").alias("dist"))


def topic_tree(hierarchy: DataFrame, names: DataFrame) -> DataFrame:
    """``(depth, path, name, topic)``: every node with the names from the root down to it; ``topic`` on leaves.

    Pointer doubling over parent ids: each node holds a pointer up and the path of names it covers; a round
    puts the path of the node it points to in front and points to that node's pointer, so a chain of depth h
    takes log2(h) rounds of one join each, written between rounds. No set of topics is joined on.
    """
    links = hierarchy.select(F.col("Child_Left_ID").alias("node"), F.col("Parent_ID").alias("up")).unionByName(
        hierarchy.select(F.col("Child_Right_ID").alias("node"), F.col("Parent_ID").alias("up")))
    labels = names.select(F.col("topic").cast("int").alias("node"), "name",
                          F.col("topic").cast("int").alias("topic")).unionByName(
        hierarchy.select(F.col("Parent_ID").cast("int").alias("node"), F.col("Parent_Name").alias("name"),
                         F.lit(None).cast("int").alias("topic")))
    above = labels.select(F.col("node").alias("up"), F.col("name").alias("path"))
    state = staged(labels.join(links, "node", "left").join(above, "up", "left").select(
        "node", "name", "topic", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"), "path"),
        "tree")
    while not state.filter(F.col("up").isNotNull()).isEmpty():
        jump = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"),
                            F.col("path").alias("before"))
        state = staged(state.join(jump, "up", "left").select(
            "node", "name", "topic", F.col("next").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.nullif(F.concat_ws(" > ", "before", "path"), F.lit("")).alias("path")), "tree")
    return state.select(F.col("depth").cast("int").alias("depth"),
                        F.concat_ws(" > ", "path", "name").alias("path"),
                        "name", "topic")
