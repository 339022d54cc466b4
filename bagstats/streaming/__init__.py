"""Structured Streaming jobs: continuous scoring and take-once ingestion."""
