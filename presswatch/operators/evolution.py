"""Topics over time: binned frequencies and words, labels, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswatch.functions.scalars import hour_label, joined_words
from presswatch.operators.filters import without_outliers
from presswatch.operators.skew import lookup_join
from presswatch.operators.topic_terms import bag_of_words, joined_terms, term_idf, top_terms
from presswatch.session import staged


def time_bin(ts: Column, low: int, high: int, bins: int = 20) -> Column:
    """1-based equal-width bin over ``[low, high]`` (epoch microseconds), right-closed, the first with its left end."""
    if high <= low:
        return F.lit(1)
    offset = (F.unix_micros(ts.cast("timestamp")) - F.lit(low)).cast("double")
    place = F.ceil(offset * F.lit(float(bins)) / F.lit(float(high - low)))
    return F.greatest(F.lit(1), F.least(F.lit(bins), place)).cast("int")


def bin_start(bin_no: Column, low: int, high: int, bins: int = 20) -> Column:
    width = (high - low) / bins
    return F.timestamp_micros((F.lit(low) + F.floor((bin_no - 1) * F.lit(width))).cast("long"))


def time_span(df: DataFrame, ts: str = "Timestamp") -> tuple[int, int] | None:
    """First and last time in epoch microseconds, or ``None`` without rows."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(micros), F.max(micros)).first()
    return None if low is None else (low, high)


def _places(frequency: DataFrame, local: DataFrame) -> DataFrame:
    """Per (topic, bin): word weight totals and the topic's neighbouring bins, null when the bin before or
    after that holds any row lacks the topic. At most ``bins`` rows per topic, as in its windows."""
    held = frequency.select("bin").distinct().withColumn("step", F.row_number().over(Window.orderBy("bin")))
    totals = local.groupBy("topic", "bin").agg(F.sum("w").alias("total"))
    around = Window.partitionBy("topic").orderBy("step")
    follows, leads = F.lag("step").over(around) == F.col("step") - 1, F.lead("step").over(around) == F.col("step") + 1
    return (
        frequency.select("topic", "bin").join(F.broadcast(held), "bin")  # at most ``bins`` rows
        .join(totals, ["topic", "bin"], "left")
        .select(
            "topic", "bin", "total",
            F.sum("total").over(Window.partitionBy("topic")).alias("topic_total"),
            F.when(follows, F.lag("bin").over(around)).alias("previous_bin"),
            F.when(follows, F.lag("total").over(around)).alias("previous_total"),
            F.when(leads, F.lead("bin").over(around)).alias("next_bin"))
    )


def topics_over_time(df: DataFrame, text: str = "Description", ts: str = "Timestamp", bins: int = 20,
                     words: int = 5, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(topic, bin, Words, Frequency, Timestamp)``.

    Word weight in a bin = mean of the topic's overall share and the bin's share, where the bin's
    share is first averaged with the one of the previous bin if the topic occurs there. Only words
    of the bin, of the bin before, or among the topic's ``words`` overall best can be among the best:
    any other word weighs half its overall share, and each overall best word weighs at least half of
    a larger one. So no full grid of bins and vocabulary is built.
    """
    docs = without_outliers(df).filter(F.col(ts).isNotNull())
    low, high = time_span(docs, ts) or (0, 0)
    docs = docs.withColumn("bin", time_bin(F.col(ts), low, high, bins))
    frequency = staged(docs.groupBy("topic", "bin").agg(F.count(F.lit(1)).alias("Frequency")), "bin-frequency")
    binned = staged(bag_of_words(docs, text, stop_words=stop_words, by=("topic", "bin")), "bin-words")

    # One shuffle by term serves the idf join and the windows; a (topic, term) has at most ``bins`` rows.
    steps = Window.partitionBy("topic", "term").orderBy("bin")
    every = Window.partitionBy("topic", "term")
    weighed = binned.join(term_idf(binned), "term").withColumn("w", F.col("n") * F.col("idf"))
    local = staged(weighed.select(
        "topic", "bin", "term", "w", F.sum("w").over(every).alias("w_all"),
        F.lag("bin").over(steps).alias("before"), F.lag("w").over(steps).alias("w_before"),
        F.lead("bin").over(steps).alias("after")), "bin-weights")
    places = _places(frequency, local)

    known = lookup_join(local, places, ["topic", "bin"], spread=["term"])
    share, whole = F.col("w") / F.col("total"), F.col("w_all") / F.col("topic_total")
    carried_in = F.when(F.col("before") == F.col("previous_bin"), F.col("w_before") / F.col("previous_total"))
    blended = F.when(F.col("previous_bin").isNotNull(), (share + F.coalesce(carried_in, F.lit(0.0))) / 2).otherwise(share)
    own = F.struct(F.col("bin").alias("at"), ((whole + blended) / 2).alias("score"))
    only_before = F.col("next_bin").isNotNull() & ~F.col("next_bin").eqNullSafe(F.col("after"))
    carried_on = F.when(only_before, F.struct(F.col("next_bin").alias("at"), ((whole + share / 2) / 2).alias("score")))
    seen = known.select("topic", "term", F.explode(F.array_compact(F.array(own, carried_on))).alias("p")).select(
        "topic", F.col("p.at").alias("bin"), "term", F.col("p.score").alias("score"))

    key = ("topic", "bin")
    overall = top_terms(local.filter(F.col("before").isNull()), words, score="w_all").select("topic", "term", "w_all")
    leading = overall.join(places, "topic").select("topic", "bin", "term", (whole / 2).alias("score"))
    best = (
        top_terms(seen, words, key=key).drop("rank").unionByName(leading)
        .groupBy("topic", "bin", "term").agg(F.max("score").alias("score"))
    )
    text_of = joined_terms(top_terms(best, words, key=key), key=key, separator=", ", name="Words")
    return frequency.join(text_of, list(key), "left").select(
        "topic", "bin", "Words", "Frequency", bin_start(F.col("bin"), low, high, bins).alias("Timestamp"))


def by_label(over_time: DataFrame) -> DataFrame:
    """Frequency sums and all words per (hour label, topic); at most one row per bin and topic goes in."""
    row = F.struct("bin", joined_words(F.col("Words")).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"])
    return over_time.withColumn("label", hour_label(F.col("Timestamp"))).groupBy("label", "topic").agg(
        F.sum("Frequency").alias("Frequency"),
        F.array_join(texts, " ").alias("Words"),
        F.min("Timestamp").alias("bin_start"),
    )


def frequency_matrix(labelled: DataFrame, topics: Sequence[int]) -> DataFrame:
    """Label × topic frequencies, 0 where a topic is absent. The topic list is given, so no extra job runs."""
    return labelled.groupBy("label").pivot("topic", list(topics)).agg(F.sum("Frequency")).na.fill(0)


def words_matrix(labelled: DataFrame, topics: Sequence[int]) -> DataFrame:
    return labelled.groupBy("label").pivot("topic", list(topics)).agg(F.max("Words"))
