"""Structured Streaming: field readings ingested from files with an idempotent foreachBatch append."""
