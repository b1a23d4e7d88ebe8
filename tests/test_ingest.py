"""Ingest order, deduplication, deltas, landed replies."""

import json

import pytest

from presswatch.operators import delta
from presswatch.queries import ingest
from presswatch import schemas
from presswatch.operators import dedup
from presswatch.operators.delta import not_processed
from presswatch.plans.ingest import LandedReplies, full_refresh, ingest_regular, ingest_trending, merged_articles
from presswatch.sources.replies import read_category, read_topics, read_trending
from presswatch.sources.tables import read_csv, read_table, write_csv

ARTICLE = "Title string, URL string, Description string, ingest_seq long"


def land(path, articles):
    path.mkdir()
    reply = {"value": [dict(zip(("name", "url", "description", "datePublished"), a)) for a in articles]}
    (path / "reply.json").write_text(json.dumps(reply))
    return str(path)


def test_topic_reply_columns(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"value": [{
        "name": "Flood gates", "webSearchUrl": "http://web.test/flood",
        "newsSearchUrl": "http://news.test/flood", "isBreakingNews": True}]}))
    df = read_topics(spark, str(tmp_path))
    assert df.columns == ["Name", "WebSearchURL", "NewsSearchURL", "IsBreakingNews"]
    assert df.collect()[0].asDict() == {
        "Name": "Flood gates", "WebSearchURL": "http://web.test/flood",
        "NewsSearchURL": "http://news.test/flood", "IsBreakingNews": True}


def test_article_reply_without_time_is_kept(spark, tmp_path):
    path = land(tmp_path / "c", [("Sample", "http://example.com/a", "Text.", None), ("B", "u", "d", "not a time")])
    got = read_category(spark, path).orderBy("source_pos").collect()
    assert [(r.Title, r.Timestamp, r.IsTrending, r.source_pos) for r in got] == [
        ("Sample", None, "no", 0), ("B", None, "no", 1)]
    assert {r.IsTrending for r in read_trending(spark, path).collect()} == {"yes"}


def test_first_copy_without_text_hides_the_later_one(rows):
    df = rows([("a", "u1", None, 1), ("b", "u1", "text", 2), ("c", "u2", "text", 3), ("d", "u2", "late", 4)], ARTICLE)
    assert [r.Title for r in dedup.distinct_articles(df).collect()] == ["c"]


def test_null_urls_are_one_url(rows):
    df = rows([("a", None, "x", 2), ("b", None, "y", 1), ("c", "u", "z", 3)], ARTICLE)
    assert sorted(r.Title for r in dedup.first_per_url(df).collect()) == ["b", "c"]


def test_source_precedence(spark, tmp_path):
    landed = LandedReplies(
        trending=(land(tmp_path / "t", [("t", "same", "from trending", "2024-01-01T00:00:00Z")]),),
        categories=(land(tmp_path / "c1", [("c1", "same", "x", "2024-01-01T00:00:00Z"),
                                           ("c1", "cat", "first category", "2024-01-01T00:00:00Z")]),
                    land(tmp_path / "c2", [("c2", "cat", "second", "2024-01-01T00:00:00Z")])),
        queries=(land(tmp_path / "q", [("q", "cat", "query", "2024-01-01T00:00:00Z"),
                                       ("q", "null", None, "2024-01-01T00:00:00Z"),
                                       ("q", "own", "query", "2024-01-01T00:00:00Z")]),))
    got = {r.URL: r.Description for r in full_refresh(spark, landed).collect()}
    assert got == {"same": "from trending", "cat": "first category", "null": None, "own": "query"}
    dropped = full_refresh(spark, landed, drop_null_description=True)
    assert dropped.count() == 3
    assert {r.URL for r in full_refresh(spark, landed, with_trending=False).collect()} == {"same", "cat", "null", "own"}


def test_ingest_is_repeatable_and_stored_rows_win(spark, tmp_path):
    table = str(tmp_path / "articles")
    landed = LandedReplies(
        trending=(land(tmp_path / "t", [("t", "u", "stored", "2024-01-01T00:00:00Z")]),),
        categories=(land(tmp_path / "c", [("c", "u", "new copy", "2024-01-02T00:00:00Z"),
                                          ("c", "v", "fresh", "2024-01-02T00:00:00Z")]),))
    ingest_trending(spark, landed, 1, table)
    ingest_regular(spark, landed, 2, table)
    again = ingest_regular(spark, landed, 3, table)
    assert {(r.URL, r.Description) for r in again.collect()} == {("u", "stored"), ("v", "fresh")}
    assert again.count() == 2


def test_merged_articles_equal_whole_deduplication(rows):
    stored = rows([("a", "u1", "x", 1), ("b", "u2", "y", 2)], ARTICLE)
    fresh = rows([("c", "u2", "z", 3), ("d", "u3", None, 4), ("e", "u3", "w", 5), ("f", "u4", "v", 6)], ARTICLE)
    merged = {r.Title for r in merged_articles(stored, fresh).collect()}
    whole = {r.Title for r in dedup.distinct_articles(dedup.union_all(stored, fresh)).collect()}
    assert merged == whole == {"a", "b", "f"}


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_delta_null_key_and_failed_rows(rows, broadcast_rows):
    fresh = rows([("n", None, "x", 1), ("a", "u1", "x", 2), ("b", "u2", "x", 3), ("b", "u2", "x", 4),
                  ("c", "u3", "x", 5)], ARTICLE)
    done = rows([(None, "r"), ("u1", None), ("u3", "r")], "URL string, LLM_Response string")
    got = not_processed(fresh, done, broadcast_rows=broadcast_rows)
    assert sorted(r.ingest_seq for r in got.collect()) == [3, 4]
    retried = not_processed(fresh, done, retry_failed=True, broadcast_rows=broadcast_rows)
    assert sorted(r.ingest_seq for r in retried.collect()) == [2, 3, 4]
    assert got.columns == fresh.columns


def test_hot_url_is_whole_in_delta(spark):
    hot = spark.range(3000).selectExpr(
        "'t' AS Title", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('u', id) END AS URL", "'d' AS Description",
        "id AS ingest_seq")
    done = spark.range(3000).filter("id % 2 = 1").selectExpr("concat('u', id) AS URL")
    got = not_processed(hot, done, broadcast_rows=0)
    assert got.filter("URL = 'hot'").count() == 1000
    assert got.count() == 1000 + 1000


def test_absent_table_and_csv_text(spark, rows, tmp_path):
    assert read_table(spark, str(tmp_path / "none"), schemas.ARTICLES).count() == 0
    df = rows([(' lead "q"', "a,b", "two\nlines", 1), ("x", None, "NA", 2)], ARTICLE)
    write_csv(df, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"), df.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[3]) == [
        (' lead "q"', "a,b", "two\nlines", 1), ("x", None, "NA", 2)]


def test_keys_are_compared_before_rows_move(spark):
    fresh = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x"), (4, "c", "x"), (5, "c", "y")],
                                  "ingest_seq long, URL string, Description string")
    nothing = fresh.filter("false")
    assert delta.not_processed(fresh, nothing, broadcast_rows=0) is fresh
    for done, left in (([("a",)], [2, 3, 4, 5]), ([(None,), ("c",)], [1, 2]), ([("a",), ("b",), (None,), ("c",)], [])):
        stored = spark.createDataFrame(done, "URL string")
        for rows in (0, 2, 100):
            got = delta.not_processed(fresh, stored, broadcast_rows=rows)
            assert sorted(r["ingest_seq"] for r in got.collect()) == left


def test_a_query_lands_the_replies_it_reads(spark):
    path = "/root/testdata/sf0.001"
    ingest._LANDED.clear()
    assert ingest.landed(spark, path, "queries").trending == ()
    assert set(ingest._LANDED[(spark.sparkContext.applicationId, path)]) == {"rows", "queries"}
    whole = ingest.landed(spark, path)
    assert whole.trending and whole.categories and whole.queries == ingest.landed(spark, path, "queries").queries
