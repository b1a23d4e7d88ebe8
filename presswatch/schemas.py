"""Explicit schemas. No reader in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(names: str, dtype: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, dtype) for n in names.split()]


TOPIC_REPLY = T.StructType([
    T.StructField("value", T.ArrayType(T.StructType(
        _fields("name webSearchUrl newsSearchUrl", T.StringType())
        + [T.StructField("isBreakingNews", T.BooleanType())]
    ))),
])

ARTICLE_REPLY = T.StructType([
    T.StructField("value", T.ArrayType(T.StructType(
        _fields("name url description datePublished", T.StringType())
    ))),
])

TRENDING_TOPICS = T.StructType(
    _fields("Name WebSearchURL NewsSearchURL", T.StringType())
    + [T.StructField("IsBreakingNews", T.BooleanType())]
)

ARTICLES = T.StructType(
    _fields("Title URL Description", T.StringType())
    + [T.StructField("Timestamp", T.TimestampType()),
       T.StructField("IsTrending", T.StringType()),
       T.StructField("ingest_seq", T.LongType())]
)

TOKEN_USAGE = T.StructType(_fields("prompt_tokens completion_tokens total_tokens", T.IntegerType()))

REPLY_FIELDS = (
    "RelevantKeywords", "ShortSummary", "Relevance", "RelevanceReason",
    "AlertFlag", "AlertReason", "NewsCategory",
)

# What an extractor call leaves on a row, before any parsing.
RAW_REPLY = T.StructType([
    T.StructField("LLM_Response", T.StringType()),
    T.StructField("LLM_Token_Usage", TOKEN_USAGE),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

ENRICHED = T.StructType(
    ARTICLES.fields
    + [T.StructField("LLM_Response", T.StringType()),
       T.StructField("LLM_Price", T.DoubleType()),
       T.StructField("LLM_Token_Usage", TOKEN_USAGE)]
    + _fields("PromptTokens CompletionTokens TotalTokens", T.IntegerType())
    + _fields(" ".join(REPLY_FIELDS), T.StringType())
    + [T.StructField("API_Timestamp", T.TimestampType())]
)

ENRICHED_TOPICS = T.StructType(ENRICHED.fields + [T.StructField("topic", T.IntegerType())])
