"""Structured Streaming: continuous ingest and windowed alerts."""
