"""The query registry, the ``articles`` view over the given tables, and small helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswatch.operators.skew import spread_out
from presswatch.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The view as SQL; the DataFrame form is ``articles``. ``documents`` give the texts, the event with
# the same id the time, flag and category, ``labels`` the relevance.
ARTICLES_SQL = """
articles AS (
  SELECT d.doc_id, left(d.text, 24) AS title, concat('http://example.com/', md5(d.text)) AS url,
    CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE d.text END AS description, e.ts AS ts,
    CASE WHEN d.doc_id % 5 = 0 THEN 'yes' ELSE 'no' END AS is_trending,
    CASE WHEN l.quality = 1 THEN 'Yes' WHEN l.quality = 0 THEN 'No' END AS relevance,
    CASE e.event_type WHEN 'error' THEN 'Red' WHEN 'purchase' THEN 'Yellow' ELSE 'Green' END AS alert_flag,
    CASE CAST(regexp_extract(e.props, '[0-9]+', 0) AS INT) % 7
      WHEN 0 THEN 'nuclear' WHEN 1 THEN 'nuclear industry' WHEN 2 THEN 'health' WHEN 3 THEN 'cybersecurity'
      WHEN 4 THEN 'geopolitical' WHEN 5 THEN 'supplychain' ELSE 'miscellaneous' END AS news_category,
    CAST(CASE WHEN d.doc_id % 11 = 0 THEN -1 ELSE d.doc_id % 8 END AS INT) AS topic,
    CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE concat(d.lang, ', ', d.source) END AS keywords,
    d.lang, d.source, l.toxic
  FROM documents d JOIN events e ON d.doc_id = e.event_id LEFT JOIN labels l ON d.doc_id = l.doc_id
)
"""

# Library column -> result column.
NAMES = {
    "ingest_seq": "doc_id", "Title": "title", "URL": "url", "Description": "description", "Timestamp": "ts",
    "IsTrending": "is_trending", "Relevance": "relevance", "AlertFlag": "alert_flag",
    "NewsCategory": "news_category", "RelevantKeywords": "keywords",
}
_BACK = {v: k for k, v in NAMES.items()}


def query(name: str, sql: str | None = None, with_articles: bool = True) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB counterpart, a list of CTEs and a SELECT after ``articles``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if with_articles:
                recursive = "RECURSIVE " if body.upper().startswith("RECURSIVE ") else ""
                body = body[len(recursive):].lstrip()
                more = not body.upper().startswith("SELECT")
                body = f"WITH {recursive}{ARTICLES_SQL.strip()}{',' if more else ''}\n{body}"
            ORACLES[name] = body
        return fn

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = use_utc(spark).read.parquet(path).schema
    return use_utc(spark).read.schema(_SCHEMAS[path]).parquet(path)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for an enriched and topic-labelled article table, whole texts included."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "doc_id").select(
        "doc_id", "ts", "event_type", "props")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    number = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 7
    names = ["nuclear", "nuclear industry", "health", "cybersecurity", "geopolitical", "supplychain", "miscellaneous"]
    category = F.element_at(F.array(*[F.lit(n) for n in names]), number + 1)
    event = F.col("event_type")
    # What a query takes of a text is worked out before rows move, so a text moves only for those that read it.
    d = d.select(
        "doc_id",
        F.left("text", F.lit(24)).alias("Title"),
        F.concat(F.lit("http://example.com/"), F.md5("text")).alias("URL"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise(F.col("text")).alias("Description"),
        "lang", "source")
    d = spread_out(d, "doc_id")
    return d.join(e, "doc_id").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ingest_seq"),
        "Title", "URL", "Description",
        F.col("ts").alias("Timestamp"),
        F.when(F.col("doc_id") % 5 == 0, "yes").otherwise("no").alias("IsTrending"),
        F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").alias("Relevance"),
        F.when(event == "error", "Red").when(event == "purchase", "Yellow").otherwise("Green").alias("AlertFlag"),
        category.alias("NewsCategory"),
        F.when(F.col("doc_id") % 11 == 0, -1).otherwise(F.col("doc_id") % 8).cast("int").alias("topic"),
        F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.concat("lang", F.lit(", "), "source")).alias(
            "RelevantKeywords"),
        "lang", "source", "toxic",
    )


def as_of(df: DataFrame) -> Column:
    """The newest time of the table as a literal, so that time filters are constants in the plan."""
    newest = df.select(F.max("Timestamp").cast("string")).first()[0]
    return F.lit(newest).cast("timestamp_ntz")


def time_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def out(df: DataFrame, *names: str | Column) -> DataFrame:
    """Select result columns by their result names; times become text."""
    picked = []
    for name in names:
        if isinstance(name, str):
            column = F.col(_BACK[name] if name in _BACK and _BACK[name] in df.columns else name)
            name = (time_text(column) if name in ("ts", "win_start", "bin_start") else column).alias(name)
        picked.append(name)
    return df.select(*picked)
