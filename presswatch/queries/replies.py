"""Reply parsing, pricing, contract checks, enrichment by an extractor and by rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from presswatch.functions.replies import (contract_violations, error_counts, with_price, with_reply_fields,
                                          with_token_columns)
from presswatch.functions.text import ENGLISH_STOP_WORDS
from presswatch.operators.enrich import with_enrichment, with_prompt, with_replies
from presswatch.operators.rules import Rules, keyword_table, with_rule_replies
from presswatch.operators.skew import in_slices
from presswatch.plans.enrichment import enrich_delta
from presswatch.queries.registry import articles, as_of, out, query
from presswatch.schemas import ARTICLES
from presswatch.session import work_path
from presswatch.sources.tables import append_table

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)

# Rule words that occur in the invented prose of the tables.
PROSE_RULES = Rules(
    relevant=("thatin", "orantion", "hehely"),
    red=("inoran", "thth"),
    yellow=("thon", "thha"),
    categories={"cybersecurity": ("rewh", "thre"), "health": ("thnt", "thing"), "supplychain": ("ononst", "thwh"),
                "geopolitical": ("thon", "erin")},
)


def stored_replies(spark, sf_dir):
    """Articles with a reply text as an extractor would leave it: whole, partial, null, list or broken."""
    key = F.col("ingest_seq")
    reply = F.to_json(F.struct(
        F.when(key % 3 != 0, F.split("RelevantKeywords", ", ")).alias("RelevantKeywords"),
        F.col("Title").alias("ShortSummary"), F.col("Relevance"), F.lit("NA").alias("RelevanceReason"),
        F.col("AlertFlag"), F.col("IsTrending").alias("AlertReason"), F.col("NewsCategory")))
    as_text = F.to_json(F.struct(F.col("RelevantKeywords"), F.col("Relevance"), F.col("AlertFlag")))
    as_null = F.concat(F.lit('{"RelevantKeywords": null, "Relevance": "No", "NewsCategory": null}'))
    kind = key % 7
    text = (
        F.when(kind == 0, as_text).when(kind == 1, as_null).when(kind == 2, F.lit("{broken"))
        .when(kind == 3, F.lit("[1]")).when(kind == 4, F.lit(None).cast("string")).otherwise(reply)
    )
    sent = F.length(F.coalesce("Description", F.lit(""))).cast("int")
    usage = F.struct(sent.alias("prompt_tokens"), F.lit(7).alias("completion_tokens"),
                     (sent + 7).alias("total_tokens"))
    rows = articles(spark, sf_dir)
    drop = ["Relevance", "AlertFlag", "NewsCategory", "RelevantKeywords"]
    return rows.withColumns({"LLM_Response": text, "LLM_Token_Usage": usage}).drop(*drop)


# The fields expected from ``stored_replies``. A null struct field is left out of the JSON text.
FIELDS_SQL = """
k AS (SELECT *, doc_id % 7 AS kind, doc_id % 7 IN (2, 3, 4) AS bad FROM articles),
fields AS (
  SELECT doc_id, topic, length(coalesce(description, '')) AS sent, bad,
    CASE WHEN bad THEN NULL WHEN kind = 0 THEN keywords WHEN kind = 1 THEN NULL
      WHEN doc_id % 3 <> 0 THEN keywords ELSE '' END AS keywords,
    CASE WHEN bad THEN NULL WHEN kind IN (0, 1) THEN '' ELSE title END AS summary,
    CASE WHEN bad THEN NULL WHEN kind = 1 THEN 'No' ELSE coalesce(relevance, '') END AS relevance,
    CASE WHEN bad THEN NULL WHEN kind IN (0, 1) THEN '' ELSE 'NA' END AS relevance_reason,
    CASE WHEN bad THEN NULL WHEN kind = 1 THEN '' ELSE alert_flag END AS alert_flag,
    CASE WHEN bad THEN NULL WHEN kind IN (0, 1) THEN '' ELSE is_trending END AS alert_reason,
    CASE WHEN bad OR kind = 1 THEN NULL WHEN kind = 0 THEN '' ELSE news_category END AS news_category
  FROM k)
"""


@query("reply_fields", FIELDS_SQL + """
SELECT doc_id, keywords, summary, relevance, relevance_reason, alert_flag, alert_reason, news_category FROM fields
""")
def reply_fields(spark, sf_dir):
    return out(with_reply_fields(stored_replies(spark, sf_dir)), "doc_id", "keywords",
               F.col("ShortSummary").alias("summary"), "relevance", F.col("RelevanceReason").alias("relevance_reason"),
               "alert_flag", F.col("AlertReason").alias("alert_reason"), "news_category")


@query("reply_tokens_and_price", """
SELECT doc_id, CAST(length(coalesce(description, '')) AS INT) AS prompt_tokens, 7 AS completion_tokens,
  CAST(length(coalesce(description, '')) + 7 AS INT) AS total_tokens,
  round((length(coalesce(description, '')) * 0.004::DOUBLE + 7 * 0.0119::DOUBLE) / 1000, 9) AS price FROM articles
""")
def reply_tokens_and_price(spark, sf_dir):
    rows = with_price(with_token_columns(stored_replies(spark, sf_dir)), "gpt4o")
    return out(rows, "doc_id", F.col("PromptTokens").alias("prompt_tokens"),
               F.col("CompletionTokens").alias("completion_tokens"), F.col("TotalTokens").alias("total_tokens"),
               F.round("LLM_Price", 9).alias("price"))


@query("contract_violations", FIELDS_SQL + """,
n AS (SELECT *, coalesce(len(list_filter(list_transform(string_split(keywords, ','), lambda w: trim(w)),
  lambda w: w <> '')), 0) AS words FROM fields)
SELECT count(*) AS replies,
  count(*) FILTER (relevance IS NOT NULL AND relevance NOT IN ('Yes', 'No')) AS bad_relevance,
  count(*) FILTER (relevance IS NOT NULL AND NOT coalesce(alert_flag IN ('Red', 'Yellow', 'Green'), FALSE)) AS bad_flag,
  count(*) FILTER (relevance IS NOT NULL AND NOT coalesce(news_category IN
    ('health', 'cybersecurity', 'geopolitical', 'supplychain', 'miscellaneous'), FALSE)) AS bad_category,
  count(*) FILTER (relevance IS NOT NULL AND words NOT BETWEEN 3 AND 5) AS bad_keyword_count,
  count(*) FILTER (relevance = 'No' AND alert_flag <> 'Green') AS irrelevant_not_green
FROM n
""")
def contract_violations_query(spark, sf_dir):
    return contract_violations(with_reply_fields(stored_replies(spark, sf_dir)))


class EchoExtractor:
    """Deterministic stand-in for a remote model: judges the whole prompt by its length, fails on some."""

    def __call__(self, prompt: str) -> tuple[str, dict[str, int]]:
        size = len(prompt)
        if size % 10 == 0:
            raise RuntimeError("HTTP 429 too many requests")
        if size % 10 == 1:
            raise RuntimeError("HTTP 500")
        reply = {"RelevantKeywords": ["size", str(size)], "Relevance": "Yes" if size % 2 else "No",
                 "AlertFlag": "Red" if size % 3 == 0 else "Green"}
        return json.dumps(reply), {"prompt_tokens": size, "completion_tokens": 3, "total_tokens": size + 3}


def _called(spark, sf_dir):
    rows = articles(spark, sf_dir).drop("Relevance", "AlertFlag", "NewsCategory", "RelevantKeywords")
    return with_replies(with_prompt(rows, "{news_content}"), EchoExtractor, wait_seconds=0.0)


SIZE_SQL = "s AS (SELECT *, length(concat(coalesce(title, ''), '. ', coalesce(description, ''))) AS size FROM articles)"


@query("extractor_enrichment", SIZE_SQL + """,
t AS (SELECT *, size % 10 > 1 AS good FROM s)
SELECT doc_id, CASE WHEN good THEN concat('size, ', size) END AS keywords,
  CASE WHEN good THEN CASE WHEN size % 2 = 1 THEN 'Yes' ELSE 'No' END END AS relevance,
  CASE WHEN good THEN CASE WHEN size % 3 = 0 THEN 'Red' ELSE 'Green' END END AS alert_flag,
  CASE WHEN good THEN '' END AS news_category,
  CASE WHEN good THEN CAST(size + 3 AS INT) END AS total_tokens,
  CASE WHEN good THEN round((size * 0.004::DOUBLE + 3 * 0.0119::DOUBLE) / 1000, 9) END AS price,
  CASE WHEN good THEN (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM articles) END AS stamp
FROM t
""")
def extractor_enrichment(spark, sf_dir):
    done = with_enrichment(_called(spark, sf_dir), "gpt4o", as_of(articles(spark, sf_dir)))
    return out(done, "doc_id", "keywords", "relevance", "alert_flag", "news_category",
               F.col("TotalTokens").alias("total_tokens"), F.round("LLM_Price", 9).alias("price"),
               F.date_format("API_Timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("extractor_errors", SIZE_SQL + """
SELECT count(*) FILTER (size % 10 < 2) AS failed, count(*) FILTER (size % 10 = 0) AS rate_limited FROM s
""")
def extractor_errors(spark, sf_dir):
    return error_counts(_called(spark, sf_dir))


TOKENS_SQL = f"""
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM articles WHERE description IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term NOT IN ({STOP_SQL}) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS articles FROM tf GROUP BY term),
scored AS (SELECT tf.doc_id, tf.term, round(tf.tf * ln(((SELECT count(*) FROM articles) + 1.0::DOUBLE)
  / (df.articles + 1.0::DOUBLE)), 10) AS score FROM tf JOIN df ON tf.term = df.term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM scored),
best AS (SELECT doc_id, string_agg(term, ', ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 5 GROUP BY doc_id)
"""


@query("article_keywords", TOKENS_SQL + "SELECT doc_id, keywords FROM best")
def article_keywords(spark, sf_dir):
    return out(keyword_table(articles(spark, sf_dir)), "doc_id", F.array_join("keywords", ", ").alias("keywords"))


def _in_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _hits(words) -> str:
    return f"list_filter({_in_list(words)}, lambda x: list_contains(seen, x))"


_CATEGORY_SQL = " ".join(
    f"WHEN len({_hits(words)}) > 0 THEN '{name}'" for name, words in PROSE_RULES.categories.items())


@query("rule_enrichment", TOKENS_SQL + f""",
s AS (SELECT doc_id, coalesce(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}'), []) AS seen,
  list_filter(list_transform(regexp_split_to_array(description, '[.!?]\\s+'), lambda x: trim(x, ' ')),
    lambda x: x <> '') AS parts FROM articles),
h AS (SELECT *, {_hits(PROSE_RULES.relevant)} AS why, {_hits(PROSE_RULES.red)} AS red,
  {_hits(PROSE_RULES.yellow)} AS yellow FROM s)
SELECT h.doc_id, coalesce(best.keywords, '') AS keywords,
  coalesce(array_to_string(parts[1:2], '. '), '') AS summary,
  CASE WHEN len(why) > 0 THEN 'Yes' ELSE 'No' END AS relevance,
  CASE WHEN len(why) > 0 THEN concat('Mentions ', array_to_string(why, ', ')) ELSE 'NA' END AS relevance_reason,
  CASE WHEN len(why) > 0 AND len(red) > 0 THEN 'Red' WHEN len(why) > 0 AND len(yellow) > 0 THEN 'Yellow'
    ELSE 'Green' END AS alert_flag,
  CASE WHEN len(why) > 0 AND len(red) > 0 THEN concat('Mentions ', array_to_string(red, ', '))
    WHEN len(why) > 0 AND len(yellow) > 0 THEN concat('Mentions ', array_to_string(yellow, ', '))
    ELSE 'NA' END AS alert_reason,
  CASE {_CATEGORY_SQL} ELSE 'miscellaneous' END AS news_category,
  CAST(len(seen) AS INT) AS prompt_tokens
FROM h LEFT JOIN best ON h.doc_id = best.doc_id
""")
def rule_enrichment(spark, sf_dir):
    rows = articles(spark, sf_dir)
    bare = rows.select("ingest_seq", "Title", "URL", "Description", "Timestamp")
    done = with_enrichment(with_rule_replies(bare, PROSE_RULES), "gpt4o", as_of(rows))
    return out(done, "doc_id", "keywords", F.col("ShortSummary").alias("summary"), "relevance",
               F.col("RelevanceReason").alias("relevance_reason"), "alert_flag",
               F.col("AlertReason").alias("alert_reason"), "news_category",
               F.col("PromptTokens").alias("prompt_tokens"))


@query("enriched_table", f"""
s AS (SELECT doc_id, coalesce(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}_]{{2,}}'), []) AS seen FROM articles)
SELECT doc_id, CASE WHEN len({_hits(PROSE_RULES.relevant)}) > 0 THEN 'Yes' ELSE 'No' END AS relevance,
  CAST(len(seen) AS INT) AS prompt_tokens FROM s
""")
def enriched_table(spark, sf_dir):
    """The enrichment job run twice over a stored article table: the second run finds nothing to enrich."""
    rows = articles(spark, sf_dir)
    moment = rows.select(F.max("Timestamp").cast("string")).first()[0]
    source, target = work_path(spark, "articles"), work_path(spark, "enriched")
    for part in in_slices(rows, "ingest_seq"):
        append_table(part.select(*[
            F.col(c).cast(ARTICLES[c].dataType).alias(c) for c in ARTICLES.fieldNames()]), source)
    for _ in range(2):
        done = enrich_delta(spark, source, target, moment, rules=PROSE_RULES)
    return out(done, "doc_id", "relevance", F.col("PromptTokens").alias("prompt_tokens"))
