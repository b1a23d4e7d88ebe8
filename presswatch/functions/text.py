"""Tokens and stop words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Runs of two or more letters, digits or underscores, of any script.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


# The English stop words of the Spark ML library, a default for the ``stop_words`` parameters.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd
he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot
could here's how's let's ought that's there's what's when's where's who's why's would
""".split())


def words(text: Column) -> Column:
    """All words of a text, lower-cased, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def term_rows(df: DataFrame, text: str, keep: Sequence[str], stop_words: Sequence[str] | None = None,
              once: bool = False) -> DataFrame:
    """One row per word occurrence (per distinct word with ``once``) with the ``keep`` columns, stop words out.

    The stop-word test runs after ``explode`` so that it is a hashed set lookup in generated code. It is
    passed as one expression text, not as one literal per word.
    """
    stop = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    found = F.array_distinct(words(F.col(text))) if once else words(F.col(text))
    rows = df.select(*keep, F.explode(found).alias("term"))
    if not stop:
        return rows
    listed = ", ".join("'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'" for word in stop)
    return rows.filter(F.expr(f"term NOT IN ({listed})"))


def sentences(text: Column, count: int = 2) -> Column:
    """The first ``count`` sentences; the whole text when it has fewer."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_join(F.slice(parts, 1, count), ". ")
