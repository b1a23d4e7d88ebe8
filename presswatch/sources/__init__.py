"""Readers and writers: search replies, article tables, reports."""
