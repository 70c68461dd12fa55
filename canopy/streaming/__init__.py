"""Structured Streaming forms of ingest, windows, joins and keyed state."""
