"""Spark-native news-risk analytics: ingest, retention, enrichment, alert reports and topic analytics."""
