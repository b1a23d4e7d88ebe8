"""Quality rules by robust multivariate outliers, in DataFrame functions alone.

Statistics of a text: words (runs without ASCII white space), code points in words, symbols, lines equal to
an earlier line, words in repeated three-word windows. A text of fewer than 50 words, or with more than half
of them repeated, fails at once. The others are vectors of ``FEATURES`` transformed rates, compared within
their language and source. Where these have fewer than ``LEAST_ROWS`` vectors, they are compared with the fit
of their language over all sources, and where that has too few as well, with the fit of all rows:

1. Start: medians and median deviations give each vector a distance.
2. Minimum covariance determinant by C-steps: the half of a group (``SUBSET`` = 0.75 of it) with the
   smallest distances gives mean and covariance, these give new distances; a step cannot raise the
   determinant, and the steps end when no group's falls further.
3. The covariance is scaled to be consistent at the normal distribution, estimated once more from all
   vectors within the 0.975 quantile of chi-square, and a vector beyond the 0.999 quantile is rejected.

Quantiles are exact on a grid (``GRID`` of a unit, distances on a log scale), so an aggregation buffer is
bounded by the grid, a group that holds a third of all rows is combined in each task first, and results do
not depend on the order of rows. Each variance has the square of its feature's ``FLOORS`` added, the
resolution of its rate: a character in 50 words; a symbol in 2,400 characters, a repeated line in 48 or a
repeated window in 143 words, which are 0.35 on their scales. So a rate that is equal in most of a group does
not make every other value an outlier.

Defined cases: a null text has no words and fails; null languages and sources are groups like others; the
fit of all rows has no least number, so every vector has a distance; repeated rows count each; other columns
are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswatch.llm.common import fresh
from presswatch.session import staged

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate")
SUBSET = 0.75
GRID = 100
FLOORS = (0.02, 0.35, 0.35, 0.35)
LEAST_ROWS = 40
ALL = "*"
CHI_975, CHI_999 = 11.143, 18.467
MAX_STEPS = 50


def text_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, body.alias("_body"))
    df = df.select(*keep, "_body", F.filter(F.split("_body", SPACE), lambda w: w != "").alias("_words"),
                   F.filter(F.split("_body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    windows = F.expr("""CASE WHEN size(_words) >= 3 THEN transform(sequence(0, size(_words) - 3),
        i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, i)) ELSE array() END""")
    df = df.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("n_lines"), F.sort_array(windows).alias("_sorted"))
    # In hash order equal windows are neighbours; the words of those cover places i, i + 1 and i + 2.
    twice = F.filter("_sorted", lambda e, i: (e["h"] == F.get("_sorted", i - 1)["h"])
                     | (e["h"] == F.get("_sorted", i + 1)["h"]))
    df = df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", twice.alias("_twice"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "_twice", lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    return df.withColumn("n_repeat_words", covered.cast("long")).drop("_twice")


def _vectors() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [(F.col("word_chars") / n).alias("x0"),
            F.log1p(1000 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x1"),
            F.log1p(20 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x2"),
            F.log1p(20 * F.col("n_repeat_words") / n).alias("x3")]


def _grid(value: Column) -> Column:
    return F.round(value * GRID).cast("long")


def _scatter(members: DataFrame, scale: float) -> DataFrame:
    """Mean, and the factors of the covariance (unit lower triangle l, diagonal d), of each group."""
    p = range(len(FEATURES))
    sums = members.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in p],
        *[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in p for j in range(i + 1)])
    for i in p:
        for j in range(i + 1):
            c = (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
            sums = sums.withColumn(f"c{i}{j}", F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2 if i == j else c)
    for j in p:
        done = sum((F.col(f"l{j}{k}") ** 2 * F.col(f"d{k}") for k in range(j)), F.lit(0.0))
        sums = sums.withColumn(f"d{j}", F.greatest(F.col(f"c{j}{j}") - done, F.lit(1e-9)))
        for i in range(j + 1, len(FEATURES)):
            done = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") * F.col(f"d{k}") for k in range(j)), F.lit(0.0))
            sums = sums.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - done) / F.col(f"d{j}"))
    log_det = sum((F.log(f"d{i}") for i in p), F.lit(0.0))
    return sums.select("g", *[f"m{i}" for i in p], *[f"d{i}" for i in p],
                       *[f"l{i}{j}" for i in p for j in range(i)], log_det.alias("log_det"))


def _distances(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance to their group, by forward substitution."""
    p = range(len(FEATURES))
    df = rows.join(fit, "g")
    for i in p:
        done = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", F.col(f"x{i}") - F.col(f"m{i}") - done)
    return df.select(*rows.columns, sum((F.col(f"y{i}") ** 2 / F.col(f"d{i}") for i in p), F.lit(0.0)).alias("dist"))


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows of each group whose distance is in the lower ``SUBSET``; ties stay in."""
    at = _grid(F.log1p("dist"))
    limits = rows.groupBy("g").agg(F.percentile(at, F.lit(SUBSET)).alias("limit"))
    return rows.join(limits, "g").filter(at <= F.ceil("limit")).drop("limit")


def consistency(share: float, limit: float) -> float:
    """What the covariance of the nearest ``share`` of four normal variables is short of."""
    half = limit / 2
    return share / (1 - math.exp(-half) * (1 + half + half * half / 2))


def robust_fit(vectors: DataFrame) -> DataFrame:
    """Mean and covariance factors of each group ``g`` of the columns x0, x1, ... (see ``_scatter``)."""
    p = range(len(FEATURES))
    mid = vectors.groupBy("g").agg(*[(F.percentile(_grid(F.col(f"x{i}")), F.lit(0.5)) / GRID).alias(f"m{i}") for i in p])
    near = vectors.join(mid, "g")
    spread = near.groupBy("g").agg(*[
        (F.percentile(_grid(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))), F.lit(0.5)) / GRID * 1.4826).alias(f"e{i}")
        for i in p])
    start = near.join(spread, "g").withColumn("dist", sum(
        (((F.col(f"x{i}") - F.col(f"m{i}")) / F.greatest(F.col(f"e{i}"), F.lit(FLOORS[i]))) ** 2 for i in p), F.lit(0.0)))
    chi_75 = 5.385
    fit = staged(_scatter(_nearest(start.select(*vectors.columns, "dist")), 1.0), "mcd-fit")
    for _ in range(MAX_STEPS):
        after = staged(_scatter(_nearest(_distances(vectors, fit)), 1.0), "mcd-fit")
        falls = after.alias("a").join(fit.alias("b"), "g").filter("a.log_det < b.log_det - 1e-6")
        done, fit = falls.isEmpty(), after
        if done:
            break
    scale = consistency(SUBSET, chi_75)
    scaled = staged(_scatter(_nearest(_distances(vectors, fit)), scale), "mcd-fit")
    inside = _distances(vectors, scaled).filter(F.col("dist") <= CHI_975)
    return staged(_scatter(inside, consistency(0.975, CHI_975)), "mcd-fit")


def fit_groups(stats: DataFrame) -> DataFrame:
    """(g0, g): the group whose fit judges language and source ``g0``: itself, its language ``g1`` or all rows."""
    sizes = stats.groupBy("g0", "g1").agg(F.count_if(~F.col("base_failed")).alias("n0"))
    langs = sizes.groupBy("g1").agg(F.sum("n0").alias("n1"))
    group = F.when(F.col("n0") >= LEAST_ROWS, F.col("g0")).when(F.col("n1") >= LEAST_ROWS, F.col("g1")).otherwise(ALL)
    return staged(sizes.join(langs, "g1").select("g0", group.alias("g")), "fit-groups")


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
           keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all) columns of ``docs`` with the statistics, base_failed, distance and kept."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    names = [c for c in (keep or docs.columns) if c not in new]
    levels = by_source, by_lang = fresh("g0", docs), fresh("g1", docs)
    marked = docs.withColumn(by_source, F.concat(F.lit("s"), F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))))
    marked = marked.withColumn(by_lang, F.concat(F.lit("l"), F.to_json(F.struct(F.col(lang).alias("l")))))
    inner = {c: f"_k{i}" for i, c in enumerate([*names, *levels])}
    stats = text_statistics(marked.select(*[F.col(c).alias(k) for c, k in inner.items()], F.col(text).alias("_text")),
                            "_text", list(inner.values()))
    stats = stats.withColumnRenamed(inner[by_source], "g0").withColumnRenamed(inner[by_lang], "g1")
    stats = staged(stats.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "text-statistics")
    chosen = fit_groups(stats)
    vectors = stats.filter("NOT base_failed").select(F.explode(F.array("g0", "g1", F.lit(ALL))).alias("g"), *_vectors())
    fit = robust_fit(staged(vectors.join(chosen.select("g").distinct(), "g", "left_semi"), "vectors"))
    p = range(len(FEATURES))
    rows = stats.select("*", *_vectors()).join(chosen, "g0", "left")
    df = rows.join(fit, "g", "left")
    for i in p:
        done = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", F.col(f"x{i}") - F.col(f"m{i}") - done)
    distance = sum((F.col(f"y{i}") ** 2 / F.col(f"d{i}") for i in p), F.lit(0.0))
    return df.select(
        *[F.col(inner[c]).alias(c) for c in names], "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= CHI_999)).alias("kept"))
