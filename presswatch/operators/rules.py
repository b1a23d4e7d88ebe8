"""Built-in rule extractor: replies without a remote model, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.functions.text import sentences, term_rows, words
from presswatch.operators.dedup import top_per_key
from presswatch.operators.skew import frequent_join
from presswatch.session import staged


@dataclass(frozen=True)
class Rules:
    """Lower-case words that decide relevance, flag and category (first category with a hit wins)."""

    relevant: Sequence[str] = (
        "nuclear", "reactor", "decommissioning", "sellafield", "radiation", "uranium", "cyberattack",
        "ransomware", "shortage", "outbreak", "sanctions",
    )
    red: Sequence[str] = ("leak", "explosion", "attack", "meltdown", "evacuation", "breach")
    yellow: Sequence[str] = ("strike", "delay", "warning", "investigation", "shortage")
    categories: Mapping[str, Sequence[str]] = field(default_factory=lambda: {
        "cybersecurity": ("cyberattack", "ransomware", "hacker", "malware", "breach"),
        "health": ("health", "safety", "radiation", "outbreak", "hospital"),
        "supplychain": ("supply", "shortage", "logistics", "shipping", "port"),
        "geopolitical": ("sanctions", "war", "treaty", "minister", "election"),
    })
    otherwise: str = "miscellaneous"


def document_frequencies(df: DataFrame, text: str = "Description") -> tuple[DataFrame, float]:
    """``(term, articles)``, written once, and the number of rows."""
    described = df.filter(F.col(text).isNotNull())
    spread = staged(term_rows(described, text, keep=[], once=True).groupBy("term").agg(
        F.count(F.lit(1)).alias("articles")), "frequencies")
    return spread, df.select(F.count(F.lit(1)).cast("double").alias("total")).scalar()


def keyword_table(df: DataFrame, key: str = "ingest_seq", text: str = "Description", count: int = 5,
                  known: tuple[DataFrame, float] | None = None) -> DataFrame:
    """The ``count`` highest TF-IDF words of each article: ``(key, keywords)``.

    The document frequencies (``known``, or those of ``df``) of a vocabulary that a row check finds small go to the
    articles, which stay in their tasks. Of a larger one the commonest words do: only the rows of the others shuffle,
    and none of these words is a hot join key.
    """
    spread, total = known or document_frequencies(df, text)
    described = df.filter(F.col(text).isNotNull())
    tf = term_rows(described, text, keep=[key]).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    scored = frequent_join(tf, spread, "term", "articles").withColumn(
        "score", F.round(F.col("tf") * F.ln((total + 1.0) / (F.col("articles") + 1.0)), 10))
    best = top_per_key(scored, [key], [F.col("score").desc(), F.col("term").asc()], count, rank="_rank")
    return best.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "term"))), lambda r: r["term"]).alias("keywords"))


def _hits(found: Column, listed: Sequence[str]) -> Column:
    return F.array_intersect(F.array(*[F.lit(w) for w in listed]), found)


def rule_columns(df: DataFrame, rules: Rules, text: str = "Description") -> DataFrame:
    """Relevance, flag, category, their reasons and the summary, from whole texts."""
    seen = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    df = df.withColumn("_seen", F.array_distinct(seen)).withColumns({
        "_why": _hits(F.col("_seen"), rules.relevant),
        "_red": _hits(F.col("_seen"), rules.red),
        "_yellow": _hits(F.col("_seen"), rules.yellow),
    })
    yes = F.size("_why") > 0
    red, yellow = yes & (F.size("_red") > 0), yes & (F.size("_yellow") > 0)
    category = F.lit(rules.otherwise)
    for name, listed in reversed(list(rules.categories.items())):
        category = F.when(F.size(_hits(F.col("_seen"), listed)) > 0, name).otherwise(category)
    return df.withColumns({
        "ShortSummary": F.coalesce(sentences(F.col(text)), F.lit("")),
        "Relevance": F.when(yes, "Yes").otherwise("No"),
        "RelevanceReason": F.when(yes, F.concat(F.lit("Mentions "), F.array_join("_why", ", "))).otherwise("NA"),
        "AlertFlag": F.when(red, "Red").when(yellow, "Yellow").otherwise("Green"),
        "AlertReason": F.when(red, F.concat(F.lit("Mentions "), F.array_join("_red", ", ")))
        .when(yellow, F.concat(F.lit("Mentions "), F.array_join("_yellow", ", "))).otherwise("NA"),
        "NewsCategory": category,
    }).drop("_seen", "_why", "_red", "_yellow")


def with_rule_replies(df: DataFrame, rules: Rules | None = None, key: str = "ingest_seq",
                      text: str = "Description", keywords: DataFrame | None = None) -> DataFrame:
    """The same raw reply columns an extractor call leaves, so the enrichment job takes either."""
    keyed = df.join(keyword_table(df, key, text) if keywords is None else keywords, key, "left")
    answered = rule_columns(keyed, rules or Rules(), text)
    reply = F.to_json(F.struct(
        F.coalesce("keywords", F.array().cast("array<string>")).alias("RelevantKeywords"),
        "ShortSummary", "Relevance", "RelevanceReason", "AlertFlag", "AlertReason", "NewsCategory"))
    sent = F.coalesce(F.size(words(F.col(text))), F.lit(0))
    got = F.size(words(F.col("ShortSummary")))
    return answered.select(
        *[answered[c] for c in df.columns],
        reply.alias("LLM_Response"),
        F.struct(sent.cast("int").alias("prompt_tokens"), got.cast("int").alias("completion_tokens"),
                 (sent + got).cast("int").alias("total_tokens")).alias("LLM_Token_Usage"),
        F.lit(1).alias("attempts"),
        F.lit(None).cast("string").alias("error"),
    )
