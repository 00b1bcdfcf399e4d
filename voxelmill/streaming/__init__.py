"""Structured Streaming variants of the scoring and aggregation queries."""
