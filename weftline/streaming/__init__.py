"""Incremental ingest and streaming summaries."""
