"""Recurring ingestion as Structured Streaming jobs."""
