"""Scalar functions, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswatch.config import TOKEN_RATES
from presswatch.functions import scalars as S
from presswatch.operators.embedding import cosine
from presswatch.operators.enrich import DEFAULT_TEMPLATE, with_prompt
from presswatch.queries.registry import articles, out, query, table

TEMPLATE_SQL = DEFAULT_TEMPLATE.replace("'", "''")


@query("iso_timestamps", """
SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 1 HOUR WHEN 2 THEN ts END,
  '%Y-%m-%d %H:%M:%S') AS ts FROM events
""", with_articles=False)
def iso_timestamps(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 4
    written = (
        F.when(kind == 0, F.concat(text, F.lit("0Z"))).when(kind == 1, F.concat(text, F.lit("+01:00")))
        .when(kind == 2, text).otherwise(F.concat(F.lit("on "), text))
    )
    rows = table(spark, sf_dir, "events").select("event_id", S.iso_timestamp(written).alias("ts"))
    return out(rows, "event_id", "ts")


@query("since_bounds", """
SELECT doc_id, CAST(floor(epoch(ts - INTERVAL 1 DAY)) AS BIGINT) AS since_day,
  CAST(floor(epoch(ts - INTERVAL 1 HOUR)) AS BIGINT) AS since_hour FROM articles
""")
def since_bounds(spark, sf_dir):
    ts = F.col("Timestamp")
    return out(articles(spark, sf_dir), "doc_id", S.epoch_since(ts, days=1).alias("since_day"),
               S.epoch_since(ts, hours=1).alias("since_hour"))


@query("article_texts", """
SELECT doc_id, md5(concat(coalesce(title, ''), '. ', coalesce(description, ''))) AS text_hash FROM articles
""")
def article_texts(spark, sf_dir):
    return out(articles(spark, sf_dir), "doc_id",
               F.md5(S.article_text(F.col("Title"), F.col("Description"))).alias("text_hash"))


@query("prompts", f"""
SELECT doc_id, md5(replace('{TEMPLATE_SQL}', '{{news_content}}',
  concat(coalesce(title, ''), '. ', coalesce(description, '')))) AS prompt_hash FROM articles
""")
def prompts(spark, sf_dir):
    return out(with_prompt(articles(spark, sf_dir)), "doc_id", F.md5("prompt").alias("prompt_hash"))


RATES_SQL = " ".join(
    f"WHEN '{name}' THEN prompt_tokens * {a}::DOUBLE + completion_tokens * {b}::DOUBLE" for name, (a, b) in TOKEN_RATES.items())


@query("token_prices", f"""
t AS (SELECT doc_id, CAST(length(coalesce(description, '')) AS INT) AS prompt_tokens, CAST(length(keywords) AS INT) AS completion_tokens,
  CASE doc_id % 4 WHEN 0 THEN 'openai_chat' WHEN 1 THEN 'gpt4' WHEN 2 THEN 'gpt4o' ELSE 'other' END AS model
  FROM articles)
SELECT doc_id, model, round(CAST(CASE model
    {RATES_SQL} END AS DOUBLE) / 1000, 9)
  AS price
FROM t
""")
def token_prices(spark, sf_dir):
    kind = F.col("ingest_seq") % 4
    model = F.when(kind == 0, "openai_chat").when(kind == 1, "gpt4").when(kind == 2, "gpt4o").otherwise("other")
    price = S.token_price(F.length(F.coalesce("Description", F.lit(""))), F.length("RelevantKeywords"), model)
    return out(articles(spark, sf_dir), "doc_id", model.alias("model"), F.round(price, 9).alias("price"))


@query("plain_categories", """
SELECT doc_id, CASE news_category WHEN 'nuclear industry' THEN 'nuclear' ELSE news_category END AS news_category
FROM articles
""")
def plain_categories(spark, sf_dir):
    return out(articles(spark, sf_dir), "doc_id", S.plain_category(F.col("NewsCategory")).alias("news_category"))


@query("hyperlinks", """
SELECT page_id, concat('<a href="', url,
  '" style="cursor: pointer" target="_blank" rel="noopener noreferrer">🔗</a>') AS link FROM pages
""", with_articles=False)
def hyperlinks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.hyperlink(F.col("url")).alias("link"))


@query("list_lines", """
SELECT doc_id, concat(CASE alert_flag WHEN 'Red' THEN '🔴' WHEN 'Yellow' THEN '🟡' WHEN 'Green' THEN '🟢' ELSE '' END,
  ' [', title, '](', url, ')') AS line FROM articles
""")
def list_lines(spark, sf_dir):
    line = S.list_line(S.alert_badge(F.col("AlertFlag")), F.col("Title"), F.col("URL"))
    return out(articles(spark, sf_dir), "doc_id", line.alias("line"))


@query("headings", """
SELECT doc_id, concat(upper(left(title, 1)), lower(substr(title, 2))) AS heading FROM articles
""")
def headings(spark, sf_dir):
    return out(articles(spark, sf_dir), "doc_id", S.heading(F.col("Title")).alias("heading"))


@query("short_labels", """
SELECT page_id, CASE WHEN length(url) < 30 THEN url ELSE concat(left(url, 27), '...') END AS label FROM pages
""", with_articles=False)
def short_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.short_label(F.col("url")).alias("label"))


@query("joined_words", """
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda w: trim(w)),
  lambda w: w <> ''), ' ') AS words_text, n_chars
FROM (SELECT doc_id, n_chars, replace(text, chr(10), ',') AS text FROM documents)
""", with_articles=False)
def joined_words(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(","))
    return table(spark, sf_dir, "documents").select("doc_id", S.joined_words(text).alias("words_text"), "n_chars")


@query("joined_lists", """
SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 100) AS INT) AS VARCHAR)), '_')
  AS codes FROM embeddings
""", with_articles=False)
def joined_lists(spark, sf_dir):
    codes = F.transform("embedding", lambda x: F.floor(x.cast("float") * F.lit(100.0).cast("float")).cast("int").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(codes, "_").alias("codes"))


@query("time_stamps", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%d-%I%p') AS label FROM events
""", with_articles=False)
def time_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", S.stamp_text(F.col("ts")).alias("stamp"), S.hour_label(F.col("ts")).alias("label"))


@query("rate_limit_errors", """
SELECT event_id, coalesce(contains(props, '42'), FALSE) AS limited FROM events
""", with_articles=False)
def rate_limit_errors(spark, sf_dir):
    error = F.replace(F.col("props"), F.lit("42"), F.lit("429"))
    return table(spark, sf_dir, "events").select("event_id", S.rate_limited(error).alias("limited"))


@query("cosine_similarity", """
SELECT vec_id, round(list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 6) AS cos
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_reverse(CAST(embedding AS DOUBLE[])) AS u FROM embeddings)
""", with_articles=False)
def cosine_similarity(spark, sf_dir):
    value = cosine(F.col("embedding"), F.reverse("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(value, 6).alias("cos"))


@query("blank_to_null", """
SELECT doc_id, CASE WHEN keywords IN ('', 'NA', 'None') THEN NULL ELSE keywords END AS keywords,
  CASE WHEN relevance = 'Yes' THEN 'stated' END AS reason FROM articles
""")
def blank_to_null(spark, sf_dir):
    reason = F.when(F.col("Relevance") == "Yes", "stated").otherwise("NA")
    return out(articles(spark, sf_dir), "doc_id", S.null_if_blank(F.col("RelevantKeywords")).alias("keywords"),
               S.null_if_blank(reason).alias("reason"))
