"""Tree-map counts: one row per node of AlertFlag › NewsCategory › topic › RelevantKeywords › URL › Title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.config import ALERT_FLAGS, RISK_TITLES
from presswatch.functions.scalars import hyperlink, plain_category
from presswatch.operators.filters import without_outliers

PATH = ("AlertFlag", "NewsCategory", "topic", "RelevantKeywords", "URL", "Title")


def tree_map(df: DataFrame) -> DataFrame:
    """Node counts at every prefix of the path, one root per colour, outlier topics out.

    Leaves are counted first, so the expansion to six levels works on distinct leaves and not on
    articles. ``depth`` comes from the grouping id: a real null in the path is not a roll-up null.
    """
    rows = without_outliers(df).filter(F.col("AlertFlag").isin(*ALERT_FLAGS)).select(
        "AlertFlag", plain_category(F.col("NewsCategory")).alias("NewsCategory"), "topic",
        "RelevantKeywords", hyperlink(F.col("URL")).alias("URL"), "Title")
    leaves = rows.groupBy(*PATH).agg(F.count(F.lit(1)).alias("leaf_count"))
    nodes = leaves.rollup(*PATH).agg(
        F.sum("leaf_count").alias("article_count"), F.grouping_id().alias("_gid"))
    depth = F.lit(len(PATH)) - F.round(F.log2(F.col("_gid") + 1)).cast("int")
    risk = F.lit(None).cast("string")
    for flag, title in RISK_TITLES.items():
        risk = F.when(F.col("AlertFlag") == flag, title).otherwise(risk)
    return nodes.withColumn("depth", depth).filter("depth > 0").withColumn("panel", risk).drop("_gid")
