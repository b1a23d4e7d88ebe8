"""Connected components of links, by rounds of least neighbours and label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the least node of its component.

    Each round takes the least label of a node and its neighbours and then the label of that label, so a
    chain halves per round; it ends when a round changes no label. Rounds are written to the shared
    folder. Minima are combined in each task before the shuffle, so a node with many links costs little.
    """
    both = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")),
                    "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other")))
        least = labels.join(near, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "other").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("jump"))
        after = staged(least.join(jump, "to").select("node", "was", F.least("to", "jump").alias("comp")), "labels")
        if after.filter("was <> comp").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
