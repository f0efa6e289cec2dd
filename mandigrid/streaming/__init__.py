"""Structured Streaming: ingest of new day files and roll-ups that follow them."""
