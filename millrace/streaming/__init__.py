"""Incremental ingest with Structured Streaming, an addition to the batch operators."""
