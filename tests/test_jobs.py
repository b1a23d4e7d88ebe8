"""The composed jobs end to end, and the registered queries against SQL."""

import json
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_DIR
from presswatch import schemas, session
from presswatch.config import Settings, cluster_tier
from presswatch.operators.rules import Rules
from presswatch.plans.ingest import LandedReplies
from presswatch.plans.jobs import Store, daily_job, hourly_job, stored_report
from presswatch.sources.tables import read_table

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check

SMALL = Settings(embedding_size=64, time_bins=4, regular_hours=72, trending_days=3)
THEMES = {"reactor": "nuclear reactor leak at the coastal plant, engineers said",
          "port": "shipping port shortage hits nuclear supply chains, traders said",
          "cyber": "ransomware breach hits the nuclear regulator, officials said"}


def land(folder, first, day):
    folder.mkdir(parents=True)
    items = [{"name": f"{name} {i}", "url": f"http://example.com/{name}/{i}", "description": f"{text}. Part {i}.",
              "datePublished": f"2024-03-{day:02d}T{i:02d}:00:00Z"}
             for name, text in THEMES.items() for i in range(first, first + 6)]
    (folder / "reply.json").write_text(json.dumps({"value": items}))
    return str(folder)


def test_daily_and_hourly_jobs(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    rules = Rules()
    day1 = LandedReplies(trending=(land(tmp_path / "t1", 0, 1),), categories=(land(tmp_path / "c1", 3, 1),))
    paths = daily_job(spark, store, day1, 1, "2024-03-01 23:00:00", rules=rules, settings=SMALL)
    assert session._STAGED.get() is None
    stored = read_table(spark, store.enriched, schemas.ENRICHED)
    assert stored.count() == 27 and stored.select("URL").distinct().count() == 27
    assert stored.filter("IsTrending = 'yes'").count() == 18
    for name, path in paths.items():
        assert spark.read.parquet(path).columns, name
    topics = spark.read.parquet(paths["articles_with_topics"])
    assert topics.count() == 27
    sizes = spark.read.parquet(paths["topic_freq"]).orderBy("topic").collect()
    assert [r.documents for r in sizes] == sorted((r.documents for r in sizes), reverse=True)
    assert spark.read.parquet(paths["topics_over_time"]).agg(F.sum("Frequency")).first()[0] == sum(
        r.documents for r in sizes)

    # Next day with two days of retention: day 1 goes to the backup, nothing is enriched twice.
    day3 = LandedReplies(categories=(land(tmp_path / "c3", 8, 4),))
    settings = Settings(embedding_size=64, time_bins=4, days_to_keep=2, regular_hours=72)
    hourly_job(spark, store, day3, 5, "2024-03-04 23:00:00", rules=rules, settings=settings)
    left = read_table(spark, store.articles, schemas.ARTICLES)
    # One URL of each theme is stored already, so its copy is not taken in again before retention.
    assert left.count() == 15
    assert read_table(spark, f"{store.backup}/articles", schemas.ARTICLES).count() == 27
    assert read_table(spark, store.enriched, schemas.ENRICHED).count() == 15
    panels = stored_report(spark, store, F.lit("2024-03-04 14:00:00").cast("timestamp"))
    assert panels["alerts"].count() > 0
    assert {r.AlertFlag for r in panels["alerts"].collect()} <= {"Red", "Yellow", "Green"}


def test_cluster_tiers():
    assert [cluster_tier(n) for n in (0, 99, 100, 299, 300, 399, 400, 10**9)] == [2, 2, 3, 3, 6, 6, 8, 8]


def test_entry(spark):
    board = entry.entry(spark)
    assert board.columns == ["doc_id", "alert_flag", "flag_rank", "title", "ts", "line"]
    assert board.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


QUICK = ["alert_board", "category_panels", "nuclear_panel", "distinct_articles", "retention_split", "tree_map",
         "reply_fields", "class_tf_idf", "query_search", "sliding_alert_counts", "stream_late_rows"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    message, _, good = check.compare(spark, con, name, SF_DIR)
    assert good, message
