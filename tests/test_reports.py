"""Report order and deduplication, retention, roll-up, scalars."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from presswatch.functions import scalars
from presswatch.operators import report, retention, rollup
from presswatch.operators import skew
from presswatch.operators.rules import keyword_table
from presswatch.operators.skew import lookup_join, number_rows
from presswatch import schemas
from presswatch.sources import tables

NEWS = "ingest_seq long, Title string, AlertFlag string, NewsCategory string, Timestamp timestamp, URL string, Relevance string"


def news(rows, *items):
    data = [(i, t, f, c, datetime(2024, 1, 1, h), f"u{i}", r) for i, (t, f, c, h, r) in enumerate(items)]
    return rows(data, NEWS)


def test_panel_order_and_title_dedup(rows):
    df = news(rows, ("a", "Green", "health", 1, "Yes"), ("b", "Red", "health", 1, "Yes"),
              ("c", "Red", "health", 5, "Yes"), ("b", "Yellow", "health", 9, "Yes"), ("d", None, "health", 9, "Yes"),
              ("e", "Blue", "health", 9, "Yes"), ("f", "Red", "health", 9, "No"), ("b", "Red", "geopolitical", 1, "Yes"))
    got = report.category_panels(df).orderBy("NewsCategory", "position").collect()
    assert [(r.Title, r.AlertFlag) for r in got if r.NewsCategory == "health"] == [
        ("c", "Red"), ("b", "Red"), ("a", "Green"), ("d", None), ("e", "Blue")]
    assert [r.Title for r in got if r.NewsCategory == "geopolitical"] == ["b"]
    stored = report.category_panels(df, tie="ingest").filter("NewsCategory = 'health'").orderBy("position").collect()
    assert [r.Title for r in stored][:2] == ["b", "c"]
    assert got[-1].heading == "Health"


def test_panel_limit_is_per_category(rows):
    df = news(rows, *[(f"t{i}", "Red", c, i % 24, "Yes") for i in range(30) for c in ("health", "supplychain")])
    got = report.category_panels(df, limit=4)
    assert {r["NewsCategory"]: r["count"] for r in got.groupBy("NewsCategory").count().collect()} == {
        "health": 4, "supplychain": 4}


def test_nuclear_first_copy_decides_the_colour(rows):
    df = news(rows, ("a", "Yellow", "nuclear", 1, "Yes"), ("a", "Red", "nuclear industry", 2, "Yes"),
              ("b", "Red", "nuclear", 3, "Yes"))
    got = {r.Title: r.AlertFlag for r in report.nuclear_panel(df).collect()}
    assert got == {"a": "Yellow", "b": "Red"}


def test_board_window_is_strict_and_per_colour(rows):
    df = news(rows, ("old", "Red", "x", 5, "Yes"), ("a", "Red", "x", 6, "Yes"), ("a", "Red", "x", 9, "Yes"),
              ("a", "Green", "x", 9, "Yes"), ("no", "Red", "x", 9, "No"))
    got = report.alert_board(df, F.lit("2024-01-01 10:00:00").cast("timestamp")).collect()
    assert sorted((r.AlertFlag, r.Title, r.ingest_seq) for r in got) == [("Green", "a", 3), ("Red", "a", 2)]


def test_retention_parts_add_up(rows):
    df = rows([("2024-01-05T00:00:00.1234567Z",), ("2024-01-02T00:00:00+01:00",), ("2024-01-02T00:00:00",),
               ("2024-01-01T23:59:59Z",), ("nonsense",), (None,)], "t string").withColumn(
                   "Timestamp", scalars.iso_timestamp(F.col("t")))
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    tagged = {r.t: r.retention for r in retention.with_retention(df, now, 3).collect()}
    assert tagged == {"2024-01-05T00:00:00.1234567Z": "kept", "2024-01-02T00:00:00+01:00": "archived",
                      "2024-01-02T00:00:00": "kept", "2024-01-01T23:59:59Z": "archived", "nonsense": "rejected",
                      None: "rejected"}
    parts = [retention.kept(df, now).count(), retention.archived(df, now).count(), retention.rejected(df).count()]
    assert parts == [2, 2, 2]


def test_retire_moves_rows_once(spark, rows, tmp_path):
    df = rows([(f"t{d}", f"u{d}", "x", datetime(2024, 1, d, h), "no", d) for d in range(1, 7) for h in (1, 20)]
              + [("t0", "u0", "x", None, "no", 0)],
              schemas.ARTICLES)
    root, backup = str(tmp_path / "data"), str(tmp_path / "backup")
    tables.append_table(df, f"{root}/articles")
    args = (spark, root, backup, {"articles": schemas.ARTICLES}, "2024-01-06 12:00:00", 3)
    assert tables.retire_all(*args) == {"articles": 5, "total": 5}
    assert tables.retire_all(*args) == {"articles": 0, "total": 0}
    kept = tables.read_table(spark, f"{root}/articles", schemas.ARTICLES)
    old = tables.read_table(spark, f"{backup}/articles", schemas.ARTICLES)
    assert (kept.count(), old.count()) == (8, 5)
    # A copy of an archived row that comes back is archived again without doubling.
    tables.append_table(df.filter("ingest_seq = 1"), f"{root}/articles")
    assert tables.retire_all(*args)["total"] == 2
    assert tables.read_table(spark, f"{backup}/articles", schemas.ARTICLES).count() == 5


def test_retire_moves_days_of_any_century(spark, rows, tmp_path):
    df = rows([("a", "u1", "x", datetime(1999, 5, 1), "no", 1), ("b", "u2", "x", datetime(2024, 1, 6), "no", 2),
               ("c", "u3", "x", None, "no", 3)], schemas.ARTICLES)
    root, backup = str(tmp_path / "data"), str(tmp_path / "backup")
    tables.append_table(df, f"{root}/articles")
    args = (spark, root, backup, {"articles": schemas.ARTICLES}, "2024-01-06 12:00:00", 3)
    assert [tables.retire_all(*args)["total"] for _ in range(2)] == [1, 0]
    assert sorted(r.URL for r in tables.read_table(spark, f"{root}/articles", schemas.ARTICLES).collect()) == ["u2", "u3"]


def test_tree_map_parents_are_sums(spark, rows):
    df = rows([("Red", "nuclear", 1, "k", "u1", "a"), ("Red", "nuclear industry", 1, "k", "u1", "a"),
               ("Red", None, 1, None, "u2", "b"), ("Green", "health", 2, "k", "u3", "c"),
               ("Green", "health", -1, "k", "u4", "d"), ("Blue", "health", 1, "k", "u5", "e")],
              "AlertFlag string, NewsCategory string, topic int, RelevantKeywords string, URL string, Title string")
    got = rollup.tree_map(df).collect()
    roots = {r.AlertFlag: r.article_count for r in got if r.depth == 1}
    assert roots == {"Red": 3, "Green": 1}
    assert {r.panel for r in got} == {"High Risk", "Low Risk"}
    for flag, total in roots.items():
        for depth in range(1, 7):
            assert sum(r.article_count for r in got if r.AlertFlag == flag and r.depth == depth) == total
    assert [r.article_count for r in got if r.depth == 2 and r.NewsCategory == "nuclear"] == [2]


def test_scalars(rows):
    df = rows([("a, b,, c ", "x" * 30, "x" * 29, "NA", "geoPolitical")],
              "w string, long string, short string, na string, cat string")
    got = df.select(
        scalars.joined_words(F.col("w")), scalars.short_label(F.col("long")), scalars.short_label(F.col("short")),
        scalars.null_if_blank(F.col("na")), scalars.heading(F.col("cat")),
        scalars.rate_limited(F.lit("Error 429")), scalars.rate_limited(F.lit(None).cast("string")),
        scalars.hour_label(F.lit("2024-01-05 15:30:00").cast("timestamp"))).first()
    assert tuple(got) == ("a b c", "x" * 27 + "...", "x" * 29, None, "Geopolitical", True, False, "05-03PM")


def test_number_rows_is_global(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(8)
    got = number_rows(df, [F.col("k").desc(), F.col("id").asc()], "n", start=5).collect()
    want = sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(5, 1005))


@pytest.mark.parametrize("how,count", [("inner", 900), ("left", 1000), ("left_anti", 100), ("left_semi", 900)])
def test_lookup_join_keeps_hot_key_rows(spark, how, count):
    big = spark.range(1000).selectExpr("id", "CASE WHEN id < 400 THEN 'hot' WHEN id < 900 THEN 'warm' ELSE 'none' END AS k")
    small = spark.createDataFrame([("hot", 1), ("warm", 2)], "k string, v int")
    assert lookup_join(big, small, ["k"], ["id"], how).count() == count


def test_tasks_over_texts_follow_the_size_of_the_table(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(400)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    files = spark.read.parquet(f"{tmp_path}/documents.parquet")
    size = sum(p.stat().st_size for p in (tmp_path / "documents.parquet").iterdir() if p.name.startswith("part-"))
    monkeypatch.setattr(skew, "TASK_BYTES", size // 19)
    spread = skew.spread_out(files, "doc_id")
    assert 19 <= spread.rdd.getNumPartitions() <= 21
    assert spread.count() == 400


def test_keywords_of_a_known_vocabulary_keep_articles_in_their_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha alpha beta"), (2, "beta gamma"), (3, "beta"), (4, None)],
                               "ingest_seq long, Description string")
    small = {r["ingest_seq"]: r["keywords"] for r in keyword_table(df.repartition(3, "ingest_seq")).collect()}
    assert small == {1: ["alpha", "beta"], 2: ["gamma", "beta"], 3: ["beta"]}
    plan = keyword_table(df.repartition(3, "ingest_seq"))._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan
    monkeypatch.setattr(skew, "fits", lambda *_: False)
    assert small == {r["ingest_seq"]: r["keywords"] for r in keyword_table(df).collect()}


def test_numbering_moves_rows_once(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = number_rows(df, [F.col("k").desc(), F.col("id").asc()], "n", start=5)
    assert "row_number" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert [(r["k"], r["id"]) for r in got.orderBy("n").collect()] == want
    assert [r["n"] for r in got.orderBy("n").collect()] == list(range(5, 1005))
