"""Words per topic: counts, class TF-IDF, top words, names, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswatch.functions.text import term_rows
from presswatch.operators.dedup import top_per_key
from presswatch.operators.filters import without_outliers
from presswatch.operators.skew import lookup_join

SCORE_DIGITS = 12  # scores are compared after rounding, so ties do not hang on summation order


def topic_frequency(df: DataFrame) -> DataFrame:
    """Documents per topic, outliers out."""
    return without_outliers(df).groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))


def most_frequent(freq: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest topics, returned in topic order."""
    return freq.orderBy(F.col("documents").desc(), F.col("topic").asc()).limit(n).orderBy("topic")


def first_topics(df: DataFrame, n: int = 16) -> DataFrame:
    return df.filter(F.col("topic").between(0, n - 1))


def selected_topics(vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """Vector rows of the chosen topics."""
    return lookup_join(vectors, topics.select("topic").distinct(), ["topic"], spread=["term"])


def bag_of_words(df: DataFrame, text: str = "Description", include_outliers: bool = False,
                 stop_words: Sequence[str] | None = None, by: Sequence[str] = ("topic",)) -> DataFrame:
    """``(topic, …, term, n)``: occurrences, counted in each task before the shuffle."""
    docs = df if include_outliers else without_outliers(df)
    return term_rows(docs, text, keep=by, stop_words=stop_words).groupBy(*by, "term").agg(
        F.count(F.lit(1)).alias("n"))


def topic_sizes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("topic").agg(F.sum("n").alias("words"))


def term_idf(counts: DataFrame) -> DataFrame:
    """``ln(1 + A / f)`` per term; ``A`` is the mean number of words per topic."""
    mean_words = topic_sizes(counts).agg(F.avg("words")).scalar()
    return counts.groupBy("term").agg(F.sum("n").alias("f")).select(
        "term", F.ln(F.lit(1.0) + mean_words / F.col("f")).alias("idf"))


def class_tf_idf(counts: DataFrame) -> DataFrame:
    """``(topic, term, n, score)`` with ``score = n / words(topic) · idf(term)``.

    ``counts`` is read three times (words, idf, topic sizes): pass a staged table, not a tokenising plan.
    A term has at most one row per topic, so the term join is even; the topic side is salted because
    one topic may own most of the vocabulary.
    """
    scored = counts.select("topic", "term", "n").join(term_idf(counts), "term")
    return lookup_join(scored, topic_sizes(counts), ["topic"], spread=["term"]).select(
        "topic", "term", "n", (F.col("n") / F.col("words") * F.col("idf")).alias("score"))


def top_terms(scores: DataFrame, n: int = 10, key: Sequence[str] = ("topic",), score: str = "score") -> DataFrame:
    """The ``n`` best words per topic with their ``rank``; equal scores go by word."""
    order = [F.round(F.col(score), SCORE_DIGITS).desc(), F.col("term").asc()]
    return top_per_key(scores, list(key), order, n, rank="rank")


def joined_terms(ranked: DataFrame, key: Sequence[str] = ("topic",), separator: str = "_",
                 name: str = "name") -> DataFrame:
    """Ranked words (a handful per key) as one text."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
    return ranked.groupBy(*key).agg(F.array_join(words, separator).alias(name))


def topic_names(scores: DataFrame, n: int = 5) -> DataFrame:
    return joined_terms(top_terms(scores, n))


def bar_report(scores: DataFrame, topics: int = 16, words: int = 5) -> DataFrame:
    """The first topics with their best words and scores."""
    return top_terms(first_topics(scores, topics), words).select("topic", "rank", "term", "score")
