"""Structured Streaming forms of ingest, extraction, status and retry."""
