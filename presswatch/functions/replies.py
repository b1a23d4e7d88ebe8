"""Extractor replies: JSON text to typed columns through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.config import ALERT_FLAGS, REPLY_CATEGORIES
from presswatch.functions.scalars import rate_limited, token_price
from presswatch.schemas import REPLY_FIELDS


def parsed_reply(text: Column) -> Column:
    """Reply text as VARIANT; null when it is not JSON or not a JSON object."""
    return F.when(F.regexp_like(text, F.lit(r"^\s*\{")), F.try_parse_json(text))


def _field(reply: Column, name: str) -> Column:
    """Key missing gives empty text, JSON null gives null, anything else its text."""
    path = f"$.{name}"
    value = F.try_variant_get(reply, path, "variant")
    return F.when(reply.isNull(), F.lit(None).cast("string")).when(value.isNull(), "").otherwise(
        F.try_variant_get(reply, path, "string"))


def _keywords(reply: Column) -> Column:
    """A keyword list is joined by comma and space, a text passes."""
    as_list = F.try_variant_get(reply, "$.RelevantKeywords", "array<string>")
    return F.coalesce(F.array_join(as_list, ", "), _field(reply, "RelevantKeywords"))


def with_reply_fields(df: DataFrame, response: str = "LLM_Response") -> DataFrame:
    """Add the seven reply columns; all null on a failed row."""
    return df.withColumn("_reply", parsed_reply(F.col(response))).withColumns(field_columns(F.col("_reply"))).drop(
        "_reply")


def field_columns(reply: Column) -> dict[str, Column]:
    """The seven reply columns of a parsed reply."""
    fields = {name: _field(reply, name) for name in REPLY_FIELDS}
    fields["RelevantKeywords"] = _keywords(reply)
    return fields


def with_token_columns(df: DataFrame, usage: str = "LLM_Token_Usage") -> DataFrame:
    """Token-usage struct to three integer columns."""
    return df.withColumns({
        "PromptTokens": F.col(f"{usage}.prompt_tokens"),
        "CompletionTokens": F.col(f"{usage}.completion_tokens"),
        "TotalTokens": F.col(f"{usage}.total_tokens"),
    })


def with_price(df: DataFrame, model: str | Column) -> DataFrame:
    return df.withColumn("LLM_Price", token_price(F.col("PromptTokens"), F.col("CompletionTokens"), model))


def with_contract_checks(df: DataFrame) -> DataFrame:
    """One boolean per rule of the reply format; true means broken."""
    words = F.filter(F.transform(F.split("RelevantKeywords", ","), lambda w: F.trim(w)), lambda w: w != "")
    count = F.coalesce(F.size(words), F.lit(0))
    answered = F.col("Relevance").isNotNull()
    return df.withColumns({
        "bad_relevance": answered & ~F.col("Relevance").isin("Yes", "No"),
        "bad_flag": answered & ~F.coalesce(F.col("AlertFlag").isin(*ALERT_FLAGS), F.lit(False)),
        "bad_category": answered & ~F.coalesce(F.col("NewsCategory").isin(*REPLY_CATEGORIES), F.lit(False)),
        "bad_keyword_count": answered & ~count.between(3, 5),
        "irrelevant_not_green": F.coalesce(
            (F.col("Relevance") == "No") & (F.col("AlertFlag") != "Green"), F.lit(False)),
    })


def contract_violations(df: DataFrame) -> DataFrame:
    """Violation count per rule."""
    rules = ["bad_relevance", "bad_flag", "bad_category", "bad_keyword_count", "irrelevant_not_green"]
    return with_contract_checks(df).agg(
        F.count(F.lit(1)).alias("replies"), *[F.count_if(F.col(r)).alias(r) for r in rules])


def error_counts(df: DataFrame, error: str = "error") -> DataFrame:
    """Failed calls, and how many of them were rate limits."""
    return df.agg(
        F.count_if(F.col(error).isNotNull()).alias("failed"),
        F.count_if(rate_limited(F.col(error))).alias("rate_limited"),
    )
