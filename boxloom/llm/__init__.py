"""Operators for training-data pipelines: scoring, deduplication, extraction, tokens."""
