"""Structured Streaming forms of ingest and sync."""
