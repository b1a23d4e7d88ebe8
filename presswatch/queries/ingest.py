"""Search pulls, landed replies, ingest jobs, stored tables and their retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswatch import schemas
from presswatch.operators import search
from presswatch.operators.dedup import union_all
from presswatch.operators.skew import number_rows
from presswatch.plans.ingest import LandedReplies, full_refresh, ingest_regular, ingest_trending
from presswatch.queries.registry import articles, as_of, out, query, table
from presswatch.session import staged, work_path
from presswatch.sources import replies, tables

SEARCHES = ("thatin", "orantion on", "inoran")
PULLED = ("health", "geopolitical")
PAGE = 100  # articles per landed reply
_LANDED: dict[tuple[str, str], dict] = {}


@query("query_search", """
q AS (SELECT unnest(['thatin', 'orantion on', 'inoran']) AS query),
m AS (SELECT q.query, a.doc_id, a.ts, row_number() OVER (PARTITION BY q.query ORDER BY a.ts DESC, a.doc_id) AS position
  FROM articles a JOIN q ON contains(lower(a.description), q.query)
  WHERE a.ts >= (SELECT max(ts) FROM articles) - INTERVAL '2' DAY)
SELECT query, doc_id, position FROM m WHERE position <= 100
""")
def query_search(spark, sf_dir):
    rows = articles(spark, sf_dir)
    since = as_of(rows) - F.expr("INTERVAL 2 DAYS")
    return out(search.by_query(rows, SEARCHES, since), "query", "doc_id", "position")


@query("category_pull", """
SELECT doc_id, news_category, CAST(CASE news_category WHEN 'health' THEN 1 ELSE 2 END AS INT) AS source_rank,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM articles WHERE news_category IN ('health', 'geopolitical')
  AND ts >= (SELECT max(ts) FROM articles) - INTERVAL '2' DAY
""")
def category_pull(spark, sf_dir):
    rows = articles(spark, sf_dir)
    since = as_of(rows) - F.expr("INTERVAL 2 DAYS")
    return out(search.by_category(rows, PULLED, since), "doc_id", "news_category", "source_rank", "ts")


@query("trending_topics_pull", """
t AS (SELECT p.url AS name, e.ts, regexp_extract(p.html, 'lang="([a-z]+)"', 1) AS market
  FROM pages p JOIN events e ON p.page_id = e.event_id)
SELECT name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, market FROM t
WHERE market = 'en' AND ts >= (SELECT max(ts) FROM t) - INTERVAL '12' HOUR
""", )
def trending_topics_pull(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").alias("Timestamp"))
    topics = pages.join(events, "page_id").select(
        F.col("url").alias("Name"), "Timestamp", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("Market"))
    since = as_of(topics) - F.expr("INTERVAL 12 HOURS")
    return out(search.trending_topics(topics, since, "en"), F.col("Name").alias("name"), "ts",
               F.col("Market").alias("market"))


def _stop_sql() -> str:
    from presswatch.queries.topics import STOP_SQL
    return STOP_SQL


@query("trending_best_article", f"""
w AS (SELECT text AS name, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM benchmark),
wanted AS (SELECT DISTINCT name, term FROM w WHERE term NOT IN ({_stop_sql()})),
h AS (SELECT doc_id, ts, unnest(list_distinct(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}')))
  AS term FROM articles WHERE description IS NOT NULL),
s AS (SELECT name, doc_id, ts, count(*) AS score FROM wanted JOIN h ON wanted.term = h.term GROUP BY name, doc_id, ts),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, ts DESC, doc_id) AS rn FROM s)
SELECT md5(name) AS name_hash, doc_id, score FROM r WHERE rn = 1
""")
def trending_best_article(spark, sf_dir):
    topics = table(spark, sf_dir, "benchmark").select(F.col("text").alias("Name"))
    best = search.best_article_per_topic(topics, articles(spark, sf_dir), placed=True)
    return out(best, F.md5("Name").alias("name_hash"), "doc_id", "score")


@query("source_fan_out", """
c AS (SELECT CAST(CASE news_category WHEN 'health' THEN 1 ELSE 2 END AS INT) AS source_rank, doc_id FROM articles
  WHERE news_category IN ('health', 'geopolitical')),
q AS (SELECT unnest([1, 2, 3]) AS pos, unnest(['thatin', 'orantion on', 'inoran']) AS query),
m AS (SELECT q.pos, a.doc_id, row_number() OVER (PARTITION BY q.query ORDER BY a.ts DESC, a.doc_id) AS rn
  FROM articles a JOIN q ON contains(lower(a.description), q.query))
SELECT source_rank, count(*) AS pulled, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM
  (SELECT * FROM c UNION ALL SELECT CAST(2 + pos AS INT), doc_id FROM m WHERE rn <= 100) GROUP BY source_rank
""")
def source_fan_out(spark, sf_dir):
    rows = articles(spark, sf_dir)
    queried = search.by_query(rows, SEARCHES)
    rank = F.array_position(F.array(*[F.lit(q) for q in SEARCHES]), F.col("query")).cast("int") + len(PULLED)
    pulled = union_all(
        search.by_category(rows, PULLED).select("source_rank", "ingest_seq"),
        queried.select(rank.alias("source_rank"), "ingest_seq"))
    return pulled.groupBy("source_rank").agg(
        F.count(F.lit(1)).alias("pulled"), F.min("ingest_seq").alias("first_doc"),
        F.max("ingest_seq").alias("last_doc"))


def _land(rows, path):
    """Write articles as JSON replies of ``PAGE`` articles each, ordered by URL and id."""
    numbered = number_rows(rows, [F.col("URL").asc(), F.col("ingest_seq").asc()], "place")
    item = F.struct(
        F.col("place"), F.col("Title").alias("name"), F.col("URL").alias("url"), F.col("Description").alias("description"),
        F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datePublished"))
    page = numbered.groupBy(F.floor(F.col("place") / PAGE).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda r: r.dropFields("place")).alias("value"))
    page.select("value").write.json(path)
    return path


def landed(spark, sf_dir, *kinds: str) -> LandedReplies:
    """Trending, one category and one query source, or of these the ``kinds`` alone; each landed once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    done = _LANDED.setdefault(key, {})
    wanted = kinds or ("trending", "categories", "queries")
    if any(kind not in done for kind in wanted):
        if "rows" not in done:
            done["rows"] = staged(articles(spark, sf_dir).select(
                "ingest_seq", "Title", "URL", "Description", "Timestamp", "IsTrending", "NewsCategory"), "articles")
        rows = done["rows"]
        of = {"trending": F.col("IsTrending") == "yes", "categories": F.col("NewsCategory") == "health",
              "queries": F.contains(F.lower("Description"), F.lit("thatin"))}
        for kind in wanted:
            if kind not in done:
                done[kind] = _land(rows.filter(of[kind]), work_path(spark, kind))
    return LandedReplies(**{kind: (done[kind],) for kind in wanted})


SOURCES_SQL = f"""
src AS (
  SELECT 0 AS rank, row_number() OVER (ORDER BY url, doc_id) - 1 AS n, * FROM articles WHERE is_trending = 'yes'
  UNION ALL SELECT 1, row_number() OVER (ORDER BY url, doc_id) - 1, * FROM articles WHERE news_category = 'health'
  UNION ALL SELECT 2, row_number() OVER (ORDER BY url, doc_id) - 1, * FROM articles
    WHERE contains(lower(description), 'thatin')),
sources AS (SELECT rank, n % {PAGE} AS pos, title, url, description, ts,
  CASE rank WHEN 0 THEN 'yes' ELSE 'no' END AS is_trending FROM src)
"""
_ROW_SQL = """SELECT title, url, md5(description) AS text_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, is_trending,
  CAST(pos AS INT) AS source_pos FROM sources WHERE rank = {0}"""


def _row(rows):
    return out(rows, "title", "url", F.md5("Description").alias("text_hash"), "ts", "is_trending", "source_pos")


@query("category_source", SOURCES_SQL + _ROW_SQL.format(1))
def category_source(spark, sf_dir):
    return _row(replies.read_category(spark, landed(spark, sf_dir, "categories").categories[0]))


@query("query_source", SOURCES_SQL + _ROW_SQL.format(2))
def query_source(spark, sf_dir):
    return _row(replies.read_query(spark, landed(spark, sf_dir, "queries").queries[0]))


@query("trending_source", SOURCES_SQL + _ROW_SQL.format(0))
def trending_source(spark, sf_dir):
    return _row(replies.read_trending(spark, landed(spark, sf_dir, "trending").trending[0]))


@query("trending_topic_source", """
SELECT url AS name, concat(url, '#web') AS web_search_url, concat(url, '#news') AS news_search_url,
  page_id % 2 = 0 AS is_breaking_news FROM pages
""", with_articles=False)
def trending_topic_source(spark, sf_dir):
    item = F.struct(
        F.col("url").alias("name"), F.concat("url", F.lit("#web")).alias("webSearchUrl"),
        F.concat("url", F.lit("#news")).alias("newsSearchUrl"), (F.col("page_id") % 2 == 0).alias("isBreakingNews"))
    path = work_path(spark, "topics")
    table(spark, sf_dir, "pages").select(F.array(item).alias("value")).write.json(path)
    return replies.read_topics(spark, path).select(
        F.col("Name").alias("name"), F.col("WebSearchURL").alias("web_search_url"),
        F.col("NewsSearchURL").alias("news_search_url"), F.col("IsBreakingNews").alias("is_breaking_news"))


_STORED = "url, is_trending, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, md5(description) AS text_hash"
_FIRST = """first_copy AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY rank, pos) AS rn FROM sources {0})"""


def _stored(rows):
    return out(rows, "url", "is_trending", "ts", F.md5("Description").alias("text_hash"))


@query("ingest_trending", SOURCES_SQL + "," + _FIRST.format("WHERE rank = 0")
       + f"SELECT {_STORED} FROM first_copy WHERE rn = 1 AND description IS NOT NULL")
def ingest_trending_query(spark, sf_dir):
    return _stored(ingest_trending(spark, landed(spark, sf_dir, "trending"), 1, work_path(spark, "articles")))


@query("ingest_regular", SOURCES_SQL + "," + _FIRST.format("WHERE rank > 0") + f""",
stored AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS sn FROM sources WHERE rank = 0),
kept AS (SELECT * FROM stored WHERE sn = 1 AND description IS NOT NULL)
SELECT {_STORED} FROM kept UNION ALL
SELECT {_STORED} FROM first_copy WHERE rn = 1 AND description IS NOT NULL AND url NOT IN (SELECT url FROM kept)
""")
def ingest_regular_query(spark, sf_dir):
    path = work_path(spark, "articles")
    ingest_trending(spark, landed(spark, sf_dir, "trending"), 1, path)
    return _stored(ingest_regular(spark, landed(spark, sf_dir), 2, path))


@query("full_refresh", SOURCES_SQL + "," + _FIRST.format("") + f"SELECT {_STORED} FROM first_copy WHERE rn = 1")
def full_refresh_query(spark, sf_dir):
    return _stored(full_refresh(spark, landed(spark, sf_dir)))


def _as_stored(rows):
    return rows.select(*[
        F.col(c).cast(schemas.ARTICLES[c].dataType).alias(c) for c in schemas.ARTICLES.fieldNames()])


@query("stored_table", """
SELECT doc_id, url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d') AS day FROM articles
""")
def stored_table(spark, sf_dir):
    path = work_path(spark, "stored")
    absent = tables.read_table(spark, path, schemas.ARTICLES)
    tables.append_table(_as_stored(articles(spark, sf_dir)), path)
    rows = union_all(absent, tables.read_table(spark, path, schemas.ARTICLES))
    return out(rows, "doc_id", "url", "ts", F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("csv_table", "SELECT doc_id, title, md5(description) AS text_hash FROM articles")
def csv_table(spark, sf_dir):
    path = work_path(spark, "csv")
    tables.write_csv(_as_stored(articles(spark, sf_dir)), path)
    return out(tables.read_csv(spark, path, schemas.ARTICLES), "doc_id", "title",
               F.md5("Description").alias("text_hash"))


@query("retired_table", """
c AS (SELECT max(ts) - INTERVAL '1' DAY AS cutoff FROM articles)
SELECT doc_id, CASE WHEN ts >= cutoff THEN 'kept' ELSE 'archived' END AS place FROM articles, c
""")
def retired_table(spark, sf_dir):
    """Retention of a stored table, run twice: the second run finds nothing to move."""
    root, backup = work_path(spark, "data"), work_path(spark, "backup")
    rows = staged(_as_stored(articles(spark, sf_dir)), "articles")
    tables.append_table(rows, f"{root}/articles")
    moment = rows.select(F.max("Timestamp").cast("string")).first()[0]
    for _ in range(2):
        tables.retire_all(spark, root, backup, {"articles": schemas.ARTICLES}, moment, 1)
    kept = tables.read_table(spark, f"{root}/articles", schemas.ARTICLES)
    old = tables.read_table(spark, f"{backup}/articles", schemas.ARTICLES)
    return out(union_all(kept.withColumn("place", F.lit("kept")), old.withColumn("place", F.lit("archived"))),
               "doc_id", "place")
