"""Structured Streaming forms and batch scoring."""
