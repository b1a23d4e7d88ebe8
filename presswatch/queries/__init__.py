"""Registered queries: each operator over the given tables, with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from presswatch.queries import ingest, replies, reports, scalars, streams, topics, vectors  # noqa: F401
from presswatch.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
