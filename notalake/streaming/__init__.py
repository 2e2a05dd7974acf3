"""Structured Streaming forms of the ingest, history and cache jobs."""
