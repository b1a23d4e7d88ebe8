"""Secret scans, in DataFrame functions alone.

Fixed patterns find assignments, access keys and hexadecimal runs. Beyond them, runs of at least ``RUN``
token characters are compared under two character Markov models, of random strings and of ordinary
identifiers: the sum over neighbouring characters of log p_random(b | a) - log p_ordinary(b | a). A run that
scores over ``THRESHOLD`` and overlaps no span of the patterns is one more span, of kind ``markov``.

Training is from labelled samples: random strings are the values the patterns found, over the whole corpus,
counted once each; ordinary ones the words of ``ORDINARY`` trusted documents at most (in order of a hash of
their id), as written and in capitals, as constants are. Both tables have one cell per pair of characters of ``ALPHABET`` (others share one sign), add-one
smoothed; scores are whole hundredths, so sums are exact. The table of differences is small by the alphabet.

Places come from lengths: the pieces between matches and the matches, in turn, are summed along a text as
rows of a window over that text's matches, never over whole texts.

Defined cases: a null or empty text has no spans; a null id is kept; repeated rows are scanned each; without
any random sample all random characters are equally likely.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswatch.session import staged

# The patterns of the base kinds, in the order in which they are listed.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
ASSIGN_LENGTH = 12
RUN = 16
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % RUN
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
THRESHOLD = 20.0
ORDINARY = 2000
KINDS = ("assign", "access", "hex", "markov")


def _matches(text: Column, pattern: str, group: int | None = None, guard: Column | None = None) -> Column:
    """(gap before, match, group) of each match in order."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.transform(F.arrays_zip(found.alias("a"), value.alias("b")), lambda m, i: F.struct(
        F.length(F.get(parts, i)).alias("gap"), m["a"].alias("found"), m["b"].alias("value")))
    empty = F.array().cast("array<struct<gap: int, found: string, value: string>>")
    return zipped if guard is None else F.when(guard, zipped).otherwise(empty)


def matched(docs: DataFrame, text: str) -> DataFrame:
    """(row, doc_id, assign, access, hex, markov): the matches of each text, as arrays of short strings."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains(
        "token") | low.contains("api")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        _matches(body, PATTERNS["assign"], 2, named).alias("assign"),
        _matches(body, PATTERNS["access"], guard=body.contains("AKIA")).alias("access"),
        _matches(body, PATTERNS["hex"], guard=body.rlike(PATTERNS["hex"])).alias("hex"),
        _matches(body, CANDIDATE, guard=body.rlike(CANDIDATE)).alias("markov"))


def spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of all matches, in code points."""
    rows = None
    for kind in KINDS:
        own = found.filter(F.size(kind) > 0).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m"))
        rows = own if rows is None else rows.union(own)
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.found")).over(so_far)
    placed = rows.select("row", "kind", end.cast("int").alias("end"), "m.found", "m.value")
    return placed.select("row", "kind", (F.col("end") - F.length("found")).alias("start"), "end", "value").filter(
        (F.col("kind") != "assign") | (F.length("value") >= ASSIGN_LENGTH))


def _place(character: Column) -> Column:
    """The number of a character: from 1 in the alphabet, 0 for any other."""
    return F.instr(F.lit(ALPHABET), character)


def _pairs(value: Column) -> Column:
    """The cells of the neighbouring characters of a string, as array."""
    at = F.sequence(F.lit(1), F.length(value) - 1)
    cells = F.transform(at, lambda i: _place(F.substring(value, i, F.lit(1))) * (len(ALPHABET) + 1)
                        + _place(F.substring(value, i + 1, F.lit(1))))
    return F.when(F.length(value) >= 2, cells).otherwise(F.array().cast("array<int>"))


def pair_counts(strings: DataFrame) -> dict[int, int]:
    """How often each pair of characters stands in the strings of ``value``, counted ``n`` times each."""
    cells = strings.select(F.explode(_pairs(F.col("value"))).alias("cell"), "n")
    return {r[0]: r[1] for r in cells.groupBy("cell").agg(F.sum("n")).collect()}  # one row per cell at most


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[int]:
    """Hundredths of log p_random(b | a) - log p_ordinary(b | a) for each cell."""
    size = len(ALPHABET) + 1
    out = []
    for a in range(size):
        sums = [sum(c.get(a * size + b, 0) for b in range(size)) for c in (random, ordinary)]
        for b in range(size):
            shares = [math.log((c.get(a * size + b, 0) + 1) / (s + size)) for c, s in zip(
                (random, ordinary), sums, strict=True)]
            out.append(round(100 * (shares[0] - shares[1])))
    return out


def ordinary_words(docs: DataFrame, labels: DataFrame, trust: Column, text: str, limit: int) -> DataFrame:
    """(value, n): the words of at most ``limit`` trusted documents."""
    ids = (labels.filter(trust).select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    words = docs.join(F.broadcast(ids), "doc_id").select(  # at most ``limit`` ids
        F.explode(F.split(F.col(text), r"[^A-Za-z0-9+/_=-]+")).alias("value"))
    words = words.filter(F.length("value") >= 2).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return words.union(words.select(F.upper("value"), "n"))


def secret_spans(docs: DataFrame, labels: DataFrame, trust: Column, doc_id: str = "doc_id", text: str = "text",
                 threshold: float = THRESHOLD, ordinary: int = ORDINARY) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (start, rank, end, kind) in that order.

    ``rank`` is the place of the kind in ``KINDS``; ``trust`` is a condition on a row of ``labels``.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    found = staged(matched(base, "_text"), "secret-matches")
    placed = staged(spans(found), "secret-spans")
    known = placed.filter("kind <> 'markov'")
    random = pair_counts(known.select("value", F.lit(1).alias("n")).distinct())
    words = ordinary_words(base, labels.select(F.col(doc_id).alias("doc_id"), trust.alias("_ok")), F.col("_ok"),
                           "_text", ordinary)
    table = F.split(F.lit(",".join(map(str, log_ratios(random, pair_counts(words))))), ",").cast("array<int>")
    score = F.aggregate(_pairs(F.col("value")), F.lit(0), lambda s, cell: s + F.get(table, cell))
    likely = placed.filter("kind = 'markov'").filter(score > round(100 * threshold))
    other = known.select("row", F.col("start").alias("from"), F.col("end").alias("to"))
    added = likely.join(other, (likely["row"] == other["row"]) & (F.col("from") < F.col("end"))
                        & (F.col("start") < F.col("to")), "left_anti")
    rank = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    listed = known.union(added).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "start", rank.alias("rank"), "end", "kind"))).alias("spans"))
    empty = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    return found.select("row", "doc_id").join(listed, "row", "left").select(
        F.col("doc_id").alias(doc_id), F.coalesce("spans", empty).alias("spans"))
