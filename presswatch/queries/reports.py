"""Reports, filters, deduplication, retention, windows, roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswatch.functions.scalars import flag_rank
from presswatch.operators import dedup, filters, report, retention, rollup, windows
from presswatch.operators.delta import not_processed
from presswatch.operators.skew import number_rows
from presswatch.queries.registry import articles, as_of, out, query, table

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
RANK = "CASE alert_flag WHEN 'Red' THEN 1 WHEN 'Yellow' THEN 2 WHEN 'Green' THEN 3 END"
BADGE = "CASE alert_flag WHEN 'Red' THEN '🔴' WHEN 'Yellow' THEN '🟡' WHEN 'Green' THEN '🟢' ELSE '' END"


@query("alert_board", f"""
u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS rn FROM articles),
r AS (SELECT * FROM u WHERE rn = 1 AND description IS NOT NULL AND relevance = 'Yes'
      AND ts > (SELECT max(ts) FROM articles) - INTERVAL '5' HOUR),
t AS (SELECT *, row_number() OVER (PARTITION BY alert_flag, title ORDER BY ts DESC, doc_id) AS tn FROM r)
SELECT doc_id, alert_flag, {RANK} AS flag_rank, title, {TS}, concat('• [', title, '](', url, ')') AS line
FROM t WHERE tn = 1
""")
def alert_board(spark, sf_dir):
    rows = articles(spark, sf_dir)
    board = report.alert_board(dedup.distinct_articles(rows), as_of(rows))
    return out(board, "doc_id", "alert_flag", "flag_rank", "title", "ts", "line")


def _panel_sql(order: str) -> str:
    return f"""
k AS (SELECT * FROM articles WHERE relevance = 'Yes'
      AND news_category IN ('geopolitical', 'supplychain', 'miscellaneous', 'health')),
d AS (SELECT *, row_number() OVER (PARTITION BY news_category, title ORDER BY {order}) AS tn FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY news_category ORDER BY {order}) AS position FROM d WHERE tn = 1)
SELECT news_category, concat(upper(left(news_category, 1)), lower(substr(news_category, 2))) AS heading,
  position, doc_id, alert_flag, concat({BADGE}, ' [', title, '](', url, ')') AS line
FROM n WHERE position <= 10
"""


@query("category_panels", _panel_sql(f"{RANK} NULLS LAST, ts DESC, doc_id"))
def category_panels(spark, sf_dir):
    return out(report.category_panels(articles(spark, sf_dir)),
               "news_category", "heading", "position", "doc_id", "alert_flag", "line")


@query("category_panels_stored_order", _panel_sql(f"{RANK} NULLS LAST, doc_id"))
def category_panels_stored_order(spark, sf_dir):
    return out(report.category_panels(articles(spark, sf_dir), tie="ingest"),
               "news_category", "heading", "position", "doc_id", "alert_flag", "line")


@query("nuclear_panel", f"""
t AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS tn FROM articles
      WHERE relevance = 'Yes' AND news_category IN ('nuclear', 'nuclear industry'))
SELECT doc_id, alert_flag, {RANK} AS flag_rank, title, concat({BADGE}, ' [', title, '](', url, ')') AS line
FROM t WHERE tn = 1
""")
def nuclear_panel(spark, sf_dir):
    return out(report.nuclear_panel(articles(spark, sf_dir)), "doc_id", "alert_flag", "flag_rank", "title", "line")


@query("relevant_articles", f"SELECT doc_id, title, url, {TS}, relevance FROM articles WHERE relevance = 'Yes'")
def relevant_articles(spark, sf_dir):
    return out(filters.relevant(articles(spark, sf_dir)), "doc_id", "title", "url", "ts", "relevance")


@query("described_articles", "SELECT doc_id, title, is_trending FROM articles WHERE description IS NOT NULL")
def described_articles(spark, sf_dir):
    return out(dedup.drop_missing(articles(spark, sf_dir), "Description"), "doc_id", "title", "is_trending")


@query("nuclear_articles", """
SELECT doc_id, news_category FROM articles WHERE news_category IN ('nuclear', 'nuclear industry')
""")
def nuclear_articles(spark, sf_dir):
    return out(filters.in_categories(articles(spark, sf_dir)), "doc_id", "news_category")


@query("red_articles", "SELECT doc_id, alert_flag FROM articles WHERE alert_flag = 'Red'")
def red_articles(spark, sf_dir):
    return out(filters.with_flag(articles(spark, sf_dir), "Red"), "doc_id", "alert_flag")


@query("recent_articles", f"""
SELECT doc_id, alert_flag, {TS} FROM articles WHERE ts > (SELECT max(ts) FROM articles) - INTERVAL '5' HOUR
""")
def recent_articles(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return out(filters.newer_than(rows, as_of(rows)), "doc_id", "alert_flag", "ts")


@query("flags_without_outliers", """
SELECT alert_flag, topic, count(*) AS articles FROM articles WHERE topic <> -1 GROUP BY alert_flag, topic
""")
def flags_without_outliers(spark, sf_dir):
    return out(filters.without_outliers(articles(spark, sf_dir)), "alert_flag", "topic").groupBy(
        "alert_flag", "topic").agg(F.count(F.lit(1)).alias("articles"))


@query("sorted_by_flag", f"""
SELECT doc_id, alert_flag, CAST(row_number() OVER (ORDER BY {RANK} NULLS LAST, ts DESC, doc_id) AS INT) AS position
FROM articles
""")
def sorted_by_flag(spark, sf_dir):
    rows = articles(spark, sf_dir).select("ingest_seq", "AlertFlag", "Timestamp")
    order = [flag_rank(F.col("AlertFlag")).asc_nulls_last(), F.col("Timestamp").desc(), F.col("ingest_seq").asc()]
    return out(number_rows(rows, order, "position", start=1), "doc_id", "alert_flag",
               F.col("position").cast("int").alias("position"))


@query("sorted_newest_first", f"""
SELECT doc_id, {TS}, CAST(row_number() OVER (ORDER BY ts DESC, doc_id) AS INT) AS position FROM articles
""")
def sorted_newest_first(spark, sf_dir):
    rows = articles(spark, sf_dir).select("ingest_seq", "Timestamp")
    order = [F.col("Timestamp").desc(), F.col("ingest_seq").asc()]
    return out(number_rows(rows, order, "position", start=1), "doc_id", "ts", F.col("position").cast("int").alias("position"))


@query("first_per_url", """
u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS rn FROM articles)
SELECT doc_id, url, title FROM u WHERE rn = 1
""")
def first_per_url(spark, sf_dir):
    return out(dedup.first_per_url(articles(spark, sf_dir)), "doc_id", "url", "title")


@query("distinct_articles", """
u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS rn FROM articles)
SELECT doc_id, url, md5(description) AS text_hash FROM u WHERE rn = 1 AND description IS NOT NULL
""")
def distinct_articles(spark, sf_dir):
    rows = dedup.distinct_articles(articles(spark, sf_dir))
    return out(rows, "doc_id", "url", F.md5("Description").alias("text_hash"))


@query("newest_per_title", """
u AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY ts DESC, doc_id) AS rn FROM articles
      WHERE relevance = 'Yes')
SELECT doc_id, title FROM u WHERE rn = 1
""")
def newest_per_title(spark, sf_dir):
    rows = dedup.first_per_key(
        filters.relevant(articles(spark, sf_dir)), ["Title"], [F.col("Timestamp").desc(), F.col("ingest_seq").asc()])
    return out(rows, "doc_id", "title")


@query("distinct_rows", """
SELECT DISTINCT title, url, alert_flag, news_category FROM articles
""")
def distinct_rows(spark, sf_dir):
    return out(articles(spark, sf_dir), "title", "url", "alert_flag", "news_category").distinct()


@query("distinct_categories", "SELECT DISTINCT news_category FROM articles WHERE relevance = 'Yes'")
def distinct_categories(spark, sf_dir):
    return out(dedup.distinct_values(filters.relevant(articles(spark, sf_dir)), "NewsCategory"), "news_category")


@query("stored_and_new", """
SELECT doc_id, url, relevance, NULL AS toxic FROM articles WHERE relevance IS NOT NULL
UNION ALL SELECT doc_id, url, NULL AS relevance, toxic FROM articles WHERE toxic IS NOT NULL
""")
def stored_and_new(spark, sf_dir):
    rows = articles(spark, sf_dir)
    stored = out(rows.filter(F.col("Relevance").isNotNull()), "doc_id", "url", "relevance")
    fresh = out(rows.filter(F.col("toxic").isNotNull()), "doc_id", "url", "toxic")
    return dedup.union_all(stored, fresh)


@query("backup_merge", f"""
old AS (SELECT doc_id, url, ts FROM articles WHERE ts < (SELECT max(ts) FROM articles) - INTERVAL '1' DAY),
older AS (SELECT doc_id, url, ts FROM articles WHERE ts < (SELECT max(ts) FROM articles) - INTERVAL '2' DAY)
SELECT doc_id, url, {TS} FROM (SELECT * FROM older UNION SELECT * FROM old)
""")
def backup_merge(spark, sf_dir):
    rows = articles(spark, sf_dir)
    now = as_of(rows)
    narrow = rows.select("ingest_seq", "URL", "Timestamp")
    backup = retention.archived(narrow, now, 2)
    return out(dedup.union_distinct(backup, retention.archived(narrow, now, 1)), "doc_id", "url", "ts")


@query("retention_split", """
c AS (SELECT max(ts) - INTERVAL '1' DAY AS cutoff FROM articles)
SELECT doc_id, CASE WHEN ts >= cutoff THEN 'kept' WHEN ts < cutoff THEN 'archived' ELSE 'rejected' END AS retention
FROM articles, c
""")
def retention_split(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return out(retention.with_retention(rows, as_of(rows), 1), "doc_id", "retention")


@query("retention_counts", """
c AS (SELECT max(ts) - INTERVAL '1' DAY AS cutoff FROM articles),
r AS (SELECT 'articles' AS table_name, ts FROM articles UNION ALL SELECT 'events', ts FROM events)
SELECT coalesce(table_name, 'total') AS table_name, count(*) FILTER (ts < cutoff) AS removed,
  count(*) FILTER (ts >= cutoff) AS remaining, count(*) FILTER (ts IS NULL) AS rejected
FROM r, c GROUP BY ROLLUP (table_name)
""")
def retention_counts(spark, sf_dir):
    rows = articles(spark, sf_dir)
    events = table(spark, sf_dir, "events").select(F.col("ts").alias("Timestamp"))
    return retention.removal_counts({"articles": rows, "events": events}, as_of(rows), 1)


@query("unprocessed_articles", """
done AS (SELECT url FROM articles WHERE relevance IS NOT NULL)
SELECT doc_id, url FROM articles a WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.url IS NOT DISTINCT FROM a.url)
""")
def unprocessed_articles(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return out(not_processed(rows, rows.filter(F.col("Relevance").isNotNull())), "doc_id", "url")


@query("unprocessed_or_failed", """
done AS (SELECT url FROM articles WHERE relevance IS NOT NULL AND toxic = 0)
SELECT doc_id, url FROM articles a WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.url IS NOT DISTINCT FROM a.url)
""")
def unprocessed_or_failed(spark, sf_dir):
    rows = articles(spark, sf_dir)
    stored = rows.filter(F.col("Relevance").isNotNull()).withColumn(
        "LLM_Response", F.when(F.col("toxic") == 0, F.col("Relevance")))
    return out(not_processed(rows, stored, retry_failed=True, broadcast_rows=0), "doc_id", "url")


@query("sliding_alert_counts", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS win_start, event_type, count(*) AS n
FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 4 HOUR, date_trunc('hour', ts),
  INTERVAL 1 HOUR)) AS w FROM events)
GROUP BY w, event_type
""", with_articles=False)
def sliding_alert_counts(spark, sf_dir):
    return out(windows.sliding_counts(table(spark, sf_dir, "events"), "event_type", "ts"),
               "win_start", "event_type", "n")


@query("hourly_arrival_counts", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS win_start, news_category, count(*) AS n
FROM articles GROUP BY date_trunc('hour', ts), news_category
""")
def hourly_arrival_counts(spark, sf_dir):
    return out(windows.tumbling_counts(articles(spark, sf_dir), "NewsCategory"), "win_start", "news_category", "n")


@query("tree_map", """
leaf AS (
  SELECT alert_flag, CASE news_category WHEN 'nuclear industry' THEN 'nuclear' ELSE news_category END AS news_category,
    topic, keywords, concat('<a href="', url,
      '" style="cursor: pointer" target="_blank" rel="noopener noreferrer">🔗</a>') AS url, title
  FROM articles WHERE topic <> -1 AND alert_flag IN ('Red', 'Yellow', 'Green')),
nodes AS (
  SELECT alert_flag, news_category, topic, keywords, url, title, count(*) AS article_count,
    grouping(alert_flag, news_category, topic, keywords, url, title) AS gid
  FROM leaf GROUP BY ROLLUP (alert_flag, news_category, topic, keywords, url, title))
SELECT alert_flag, news_category, topic, keywords, url, title, article_count,
  CAST(CASE gid WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 3 THEN 4 WHEN 7 THEN 3 WHEN 15 THEN 2 ELSE 1 END AS INT) AS depth,
  CASE alert_flag WHEN 'Red' THEN 'High Risk' WHEN 'Yellow' THEN 'Medium Risk' ELSE 'Low Risk' END AS panel
FROM nodes WHERE gid < 63
""")
def tree_map(spark, sf_dir):
    return out(rollup.tree_map(articles(spark, sf_dir)), "alert_flag", "news_category", "topic", "keywords", "url",
               "title", "article_count", "depth", "panel")
