"""Structured Streaming forms, run over everything that has landed and then compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswatch import schemas
from presswatch.queries.ingest import SOURCES_SQL, landed
from presswatch.queries.registry import out, query, table
from presswatch.session import use_utc, work_path
from presswatch.sources.replies import sequenced, stream_articles
from presswatch.sources.tables import read_table
from presswatch.streaming.alerts import hourly_arrivals, sliding_alerts, start_counts
from presswatch.streaming.ingest import first_arrivals, start_append
from presswatch.streaming.late import late_rows_writer


def _landed_counts(spark, sf_dir, make_counts, landings: int = 3):
    """Events land in ``landings`` turns by time (each turn newer than the last, so none is behind the
    watermark); one update-mode stream with one checkpoint runs after each landing and merges the changed
    windows into day partitions."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    span = (micros - F.lit(low or 0)) / F.lit(max((high or 0) - (low or 0), 1))
    turn = F.coalesce(F.least(F.floor(span * landings), F.lit(landings - 1)), F.lit(0))
    landing, path, offsets = work_path(spark, "landing"), work_path(spark, "counts"), work_path(spark, "offsets")
    for number in range(landings):
        events.filter(turn == number).write.mode("append").parquet(landing)
        counts = make_counts(use_utc(spark).readStream.schema(events.schema).parquet(landing))
        start_counts(counts, path, offsets, "update", key="event_type").awaitTermination()
    return spark.read.parquet(path)


@query("stream_landed_articles", SOURCES_SQL + """
SELECT title, url, md5(description) AS text_hash, is_trending FROM sources WHERE rank = 0
""")
def stream_landed_articles(spark, sf_dir):
    rows = stream_articles(spark, landed(spark, sf_dir, "trending").trending[0], trending=True)
    path = work_path(spark, "landed")
    rows.writeStream.format("parquet").option("checkpointLocation", work_path(spark, "offsets")).trigger(
        availableNow=True).start(path).awaitTermination()
    return out(spark.read.schema(rows.schema).parquet(path), "title", "url",
               F.md5("Description").alias("text_hash"), "is_trending")


@query("stream_first_arrivals", SOURCES_SQL + "SELECT DISTINCT url FROM sources WHERE rank = 1")
def stream_first_arrivals(spark, sf_dir):
    rows = first_arrivals(stream_articles(spark, landed(spark, sf_dir, "categories").categories[0])).select("URL")
    path = work_path(spark, "arrivals")
    rows.writeStream.format("parquet").option("checkpointLocation", work_path(spark, "offsets")).trigger(
        availableNow=True).start(path).awaitTermination()
    return out(spark.read.schema(rows.schema).parquet(path), "url")


@query("stream_replayed_append", SOURCES_SQL + """,
f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS rn FROM sources WHERE rank = 1)
SELECT url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM f WHERE rn = 1 AND description IS NOT NULL
""")
def stream_replayed_append(spark, sf_dir):
    """The same landed files processed by two queries with separate offsets: the second adds nothing."""
    rows = sequenced(stream_articles(spark, landed(spark, sf_dir, "categories").categories[0]), 1, 0).select(
        *schemas.ARTICLES.fieldNames())
    path = work_path(spark, "appended")
    for _ in range(2):
        start_append(rows, path, schemas.ARTICLES, work_path(spark, "offsets")).awaitTermination()
    return out(read_table(spark, path, schemas.ARTICLES), "url", "ts")


@query("stream_sliding_alerts", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS win_start, event_type, count(*) AS n
FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 4 HOUR, date_trunc('hour', ts),
  INTERVAL 1 HOUR)) AS w FROM events)
GROUP BY w, event_type
""", with_articles=False)
def stream_sliding_alerts(spark, sf_dir):
    counts = _landed_counts(spark, sf_dir, lambda rows: sliding_alerts(rows, "event_type", "ts"))
    return out(counts, "win_start", "event_type", "n")


@query("stream_hourly_arrivals", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS win_start, event_type, count(*) AS n
FROM events GROUP BY date_trunc('hour', ts), event_type
""", with_articles=False)
def stream_hourly_arrivals(spark, sf_dir):
    counts = _landed_counts(spark, sf_dir, lambda rows: hourly_arrivals(rows, "event_type", "ts"))
    return out(counts, "win_start", "event_type", "n")


LATE_DELAY, LANDINGS = "1 day", 3


@query("stream_late_rows", f"""
WITH b AS (SELECT event_id, ts, CAST(coalesce(event_id % {LANDINGS}, 0) AS INT) AS batch FROM events),
m AS (SELECT batch, max(ts) AS mx FROM b GROUP BY batch),
w AS (SELECT x.batch, (SELECT max(mx) FROM m WHERE m.batch < x.batch) - INTERVAL {LATE_DELAY} AS wm FROM m x)
SELECT b.event_id, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, b.batch FROM b JOIN w USING (batch) WHERE b.ts < w.wm
""", with_articles=False)
def stream_late_rows(spark, sf_dir):
    """Events land in three turns (by id); one stream with one checkpoint runs after each landing, so its
    micro-batches are the landings. Rows behind the watermark are archived per batch, not dropped."""
    events = table(spark, sf_dir, "events")
    landing, marks, late = work_path(spark, "landing"), work_path(spark, "marks"), work_path(spark, "late")
    offsets = work_path(spark, "offsets")
    for turn in range(LANDINGS):
        events.filter(F.coalesce(F.col("event_id") % LANDINGS, F.lit(0)) == turn).write.mode("append").parquet(landing)
        stream = use_utc(spark).readStream.schema(events.schema).parquet(landing)
        stream.writeStream.foreachBatch(late_rows_writer("ts", LATE_DELAY, marks, late)).option(
            "checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(late)
    return out(rows, "event_id", "ts", F.col("batch").cast("int").alias("batch"))
