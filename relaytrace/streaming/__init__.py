"""Structured Streaming jobs: ingest (X1), incremental merge (X2), attribution."""
