"""Structured Streaming forms of ingest and alert counts."""
