"""Structured Streaming forms of ingest, windowed totals, de-duplication, enrichment and sessions."""
