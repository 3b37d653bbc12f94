"""Reusable plan shapes: hot keys, running values over buckets, dataset generation."""
