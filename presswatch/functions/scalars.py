"""String, date and number expressions. All stay JVM-side."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswatch.config import ALERT_BADGES, ALERT_FLAGS, TOKEN_RATES


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; no zone means UTC, unparsable means null.

    A text without a date is unparsable: the cast alone would take the day from the clock.
    """
    return F.when(text.rlike(r"^\s*[+-]?\d{4,6}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))


def epoch_since(as_of: Column, days: int = 0, hours: int = 0) -> Column:
    """Lower time bound in epoch seconds, ``days``/``hours`` before ``as_of``."""
    return F.unix_timestamp((as_of - F.expr(f"INTERVAL {days} DAYS {hours} HOURS")).cast("timestamp"))


def article_text(title: Column, description: Column) -> Column:
    """``"title. description"`` with nulls as empty text."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))


def fill_template(template: str, **values: Column) -> Column:
    """Replace ``{name}`` placeholders of ``template`` by column values, in one pass.

    Doubled braces stand for one; a placeholder without a value is an error; a null value gives null.
    """
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")


def token_price(prompt_tokens: Column, completion_tokens: Column, model: Column | str) -> Column:
    """USD for one call; null for a model without a rate. ``model`` is one name or a column of names."""

    def cost(name: str) -> Column:
        rate_in, rate_out = TOKEN_RATES[name]
        return (prompt_tokens * F.lit(rate_in) + completion_tokens * F.lit(rate_out)) / F.lit(1000.0)

    if isinstance(model, str):
        return cost(model) if model in TOKEN_RATES else F.lit(None).cast("double")
    price = F.lit(None).cast("double")
    for name in TOKEN_RATES:
        price = F.when(model == name, cost(name)).otherwise(price)
    return price


def plain_category(category: Column) -> Column:
    """The tree map counts ``nuclear industry`` under ``nuclear``."""
    return F.when(category == "nuclear industry", "nuclear").otherwise(category)


def hyperlink(url: Column) -> Column:
    """The tree map's link element."""
    # Fixed value: markup of the link element.
    return F.format_string(
        '<a href="%s" style="cursor: pointer" target="_blank" rel="noopener noreferrer">🔗</a>', url)


def alert_badge(flag: Column) -> Column:
    """Coloured dot of a flag, empty for an unknown one."""
    badge = F.lit("")
    for name, mark in ALERT_BADGES.items():
        badge = F.when(flag == name, mark).otherwise(badge)
    return badge


def flag_rank(flag: Column) -> Column:
    """1 for Red, 2 for Yellow, 3 for Green, null otherwise."""
    rank = F.lit(None).cast("int")
    for position, name in enumerate(ALERT_FLAGS, start=1):
        rank = F.when(flag == name, position).otherwise(rank)
    return rank


def list_line(mark: Column, title: Column, url: Column) -> Column:
    """One markdown line of a report list."""
    return F.concat(mark, F.lit(" ["), F.coalesce(title, F.lit("")), F.lit("]("), F.coalesce(url, F.lit("")), F.lit(")"))


def heading(category: Column) -> Column:
    """First letter upper, rest lower."""
    rest = F.substring(category, F.lit(2), F.length(category))
    return F.concat(F.upper(F.substring(category, 1, 1)), F.lower(rest))


def short_label(label: Column, limit: int = 30) -> Column:
    """Labels of ``limit`` characters or more are cut and end in three dots."""
    return F.when(F.length(label) < limit, label).otherwise(
        F.concat(F.substring(label, 1, limit - 3), F.lit("...")))


def split_words(words: Column) -> Column:
    """Comma-separated text to trimmed, non-empty words."""
    return F.filter(F.transform(F.split(words, ","), lambda w: F.trim(w)), lambda w: w != "")


def joined_words(words: Column, separator: str = " ") -> Column:
    return F.array_join(split_words(words), separator)


def stamp_text(as_of: Column) -> Column:
    return F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")


def hour_label(ts: Column) -> Column:
    """Day and 12-hour clock, e.g. ``05-03PM``; does not sort in time."""
    return F.date_format(ts, "dd-hha")


def rate_limited(error: Column) -> Column:
    return F.coalesce(F.contains(error, F.lit("429")), F.lit(False))


def null_if_blank(text: Column, blanks: Sequence[str] = ("", "NA", "None")) -> Column:
    """Texts that a CSV round trip would turn into null."""
    return F.when(text.isin(*blanks), F.lit(None)).otherwise(text)
