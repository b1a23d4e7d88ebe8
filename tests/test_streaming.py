"""Streams against their batch forms; late rows; replays."""

import json
from datetime import datetime

from presswatch import schemas
from presswatch.operators.windows import sliding_counts
from presswatch.sources.replies import sequenced, stream_articles
from presswatch.sources.tables import read_table
from presswatch.streaming.alerts import sliding_alerts, start_counts
from presswatch.streaming.ingest import first_arrivals, start_append

SCHEMA = "Timestamp timestamp, AlertFlag string, URL string"


def add_batch(spark, path, items):
    spark.createDataFrame([(datetime.fromisoformat(t), f, u) for t, f, u in items], SCHEMA).coalesce(1).write.mode(
        "append").parquet(str(path))


def read_stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_sliding_counts_stream_equals_batch(spark, tmp_path):
    add_batch(spark, tmp_path / "in", [("2024-01-01T01:30:00", "Red", "a"), ("2024-01-01T03:10:00", "Green", "b")])
    add_batch(spark, tmp_path / "in", [("2024-01-01T02:00:00", "Red", "c"), ("2024-01-01T09:59:59", "Red", "d")])
    counts = sliding_alerts(read_stream(spark, tmp_path / "in"))
    start_counts(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in sliding_counts(
        spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), "AlertFlag").collect()}
    assert got == want


def test_rows_behind_the_watermark_are_not_counted(spark, tmp_path):
    source, out, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        start_counts(sliding_alerts(read_stream(spark, source), delay="1 hour"), out, offsets, "append").awaitTermination()

    add_batch(spark, source, [("2024-01-01T00:30:00", "Red", "a")])
    run()
    add_batch(spark, source, [("2024-01-02T00:30:00", "Red", "b")])
    run()
    add_batch(spark, source, [("2024-01-01T00:40:00", "Red", "late")])
    run()
    add_batch(spark, source, [("2024-01-04T00:00:00", "Red", "c")])
    run()
    got = spark.read.parquet(f"{out}/batch=*")
    first_day = got.filter("win_start < '2024-01-01 12:00:00'").collect()
    assert len(first_day) == 5 and {r.n for r in first_day} == {1}


def test_first_arrivals_lets_a_url_in_again_after_the_delay(spark, tmp_path):
    source = tmp_path / "in"
    def run():
        rows = first_arrivals(read_stream(spark, source), delay="1 day")
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    for when, url in (("2024-01-01T00:00:00", "u"), ("2024-01-01T05:00:00", "u"), ("2024-01-05T00:00:00", "v"),
                      ("2024-01-06T00:00:00", "u")):
        add_batch(spark, source, [(when, "Red", url)])
        run()
    got = sorted((r.URL, r.Timestamp.day) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())
    assert got == [("u", 1), ("u", 6), ("v", 5)]


def test_replayed_files_add_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        reply = {"value": [{"name": "t", "url": u, "description": d, "datePublished": "2024-01-01T00:00:00Z"}
                           for u, d in (("same", "x"), (f"own{n}", "y"), (f"empty{n}", None))]}
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(reply))
    table = str(tmp_path / "articles")
    for n in range(2):
        rows = sequenced(stream_articles(spark, str(tmp_path / "in"), files_per_batch=1), 1, 0)
        start_append(rows.select(*schemas.ARTICLES.fieldNames()), table, schemas.ARTICLES,
                     str(tmp_path / f"cp{n}")).awaitTermination()
    got = sorted(r.URL for r in read_table(spark, table, schemas.ARTICLES).collect())
    assert got == ["own0", "own1", "same"]


def test_late_rows_are_archived_not_dropped(spark, tmp_path):
    """Three micro-batches: rows behind max(earlier batches) - delay go to the archive, the rest to the sink;
    a replayed batch replaces its own output; rows without a time are never late."""
    from pyspark.sql import functions as F

    from presswatch.streaming.late import late_counts, late_rows_writer

    landing, marks, late, kept = (str(tmp_path / n) for n in ("landing", "marks", "late", "kept"))
    sunk = []

    def sink(rows, batch_id):
        sunk.append((batch_id, sorted(r.URL for r in rows.collect())))

    turns = [[("2024-01-05 10:00:00", "Red", "a"), ("2024-01-01 00:00:00", "Red", "b")],
             [("2024-01-05 09:00:00", "Red", "c"), ("2024-01-05 08:59:59", "Red", "d")],
             [("2024-01-02 00:00:00", "Green", "e"), ("2024-01-06 00:00:00", "Green", "f")]]
    writer = late_rows_writer("Timestamp", "1 hour", marks, late, sink)
    for turn in turns:
        add_batch(spark, landing, turn)
        spark.readStream.schema(SCHEMA).parquet(landing).writeStream.foreachBatch(writer).option(
            "checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.batch, r.URL) for r in spark.read.parquet(late).collect())
    assert got == [(1, "d"), (2, "e")]
    assert sunk == [(0, ["a", "b"]), (1, ["c"]), (2, ["f"])]
    # A replay of batch 1 (after a failure) replaces what it wrote.
    replay = spark.createDataFrame([(datetime(2024, 1, 5, 8, 59, 59), "Red", "d"), (None, "Red", "g")], SCHEMA)
    writer(replay, 1)
    got = sorted((r.batch, r.URL) for r in spark.read.parquet(late).collect())
    assert got == [(1, "d"), (2, "e")]
    assert {r.batch: r.late_rows for r in late_counts(spark, late).collect()} == {1: 1, 2: 1}
    assert sunk[-1] == (1, ["g"])
    assert spark.read.parquet(marks).filter(F.col("batch") == 1).first().max_ts == datetime(2024, 1, 5, 8, 59, 59)


def test_update_mode_merges_changed_windows_into_days(spark, tmp_path):
    """Changed windows replace their rows in their day; files of other days stay; a replay changes nothing."""
    import os

    from presswatch.streaming.alerts import merge_windows

    path = str(tmp_path / "counts")
    write = merge_windows(path, "AlertFlag")
    schema = "win_start timestamp, AlertFlag string, n long"

    def batch(rows):
        return spark.createDataFrame([(datetime.fromisoformat(t), k, n) for t, k, n in rows], schema)

    write(batch([("2024-01-01 10:00:00", "Red", 2), ("2024-01-02 10:00:00", "Red", 1),
                 ("2024-01-02 11:00:00", None, 4)]), 0)
    day_one = sorted(os.listdir(tmp_path / "counts" / "day=2024-01-01"))
    write(batch([("2024-01-02 10:00:00", "Red", 3), ("2024-01-02 12:00:00", "Green", 1)]), 1)
    write(batch([("2024-01-02 10:00:00", "Red", 3), ("2024-01-02 12:00:00", "Green", 1)]), 1)  # replayed
    got = sorted((str(r.win_start), r.AlertFlag or "", r.n) for r in spark.read.parquet(path).collect())
    assert got == [("2024-01-01 10:00:00", "Red", 2), ("2024-01-02 10:00:00", "Red", 3),
                   ("2024-01-02 11:00:00", "", 4), ("2024-01-02 12:00:00", "Green", 1)]
    assert sorted(os.listdir(tmp_path / "counts" / "day=2024-01-01")) == day_one
