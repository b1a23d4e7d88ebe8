"""Job parameters. Every time-dependent operator takes ``as_of``; nothing reads the clock."""

from __future__ import annotations

from dataclasses import dataclass

# Source lists, order matters (it is the precedence of keep-first deduplication).
CATEGORIES = ("Business", "Politics", "World", "ScienceAndTechnology", "Health", "UK")
QUERIES = (
    "nuclear industry",
    "nuclear decommissioning",
    "nuclear decommissioning authority",
    "nuclear energy",
    "nuclear power",
    "nuclear plant",
    "nuclear waste",
    "nuclear",
    "sellafield",
    "decommissioning",
)

# Alert colours in report order, with badge and heading.
ALERT_FLAGS = ("Red", "Yellow", "Green")
ALERT_BADGES = {"Red": "🔴", "Yellow": "🟡", "Green": "🟢"}
RISK_TITLES = {"Red": "High Risk", "Yellow": "Medium Risk", "Green": "Low Risk"}

# Report panels and the category list of the reply contract.
NUCLEAR_CATEGORIES = ("nuclear", "nuclear industry")
PANEL_CATEGORIES = ("geopolitical", "supplychain", "miscellaneous", "health")
REPLY_CATEGORIES = ("health", "cybersecurity", "geopolitical", "supplychain", "miscellaneous")

# USD per 1,000 prompt / completion tokens.
TOKEN_RATES = {
    "openai_chat": (0.003, 0.0004),
    "gpt4": (0.048, 0.096),
    "gpt4o": (0.004, 0.0119),
}

# Fixed values: (documents below this count, minimum cluster size = minimum samples).
CLUSTER_TIERS = ((100, 2), (300, 3), (400, 6))
CLUSTER_TIER_ABOVE = 8


@dataclass(frozen=True)
class Settings:
    """All tunables of the composed jobs."""

    categories: tuple[str, ...] = CATEGORIES
    queries: tuple[str, ...] = QUERIES
    days_to_keep: int = 3
    trending_days: int = 1
    regular_hours: int = 1
    rows_per_query: int = 100
    alert_hours: int = 5
    panel_limit: int = 10
    model: str = "gpt4o"
    max_attempts: int = 2
    retry_wait_seconds: float = 60.0
    enrich_partitions: int | None = None
    embedding_size: int = 512
    reduced_size: int = 5
    stored_words: int = 10
    shown_words: int = 5
    bar_topics: int = 16
    time_bins: int = 20


DEFAULTS = Settings()


def cluster_tier(doc_count: int) -> int:
    """Minimum cluster size (and samples) for a corpus of ``doc_count`` documents."""
    for below, size in CLUSTER_TIERS:
        if doc_count < below:
            return size
    return CLUSTER_TIER_ABOVE
