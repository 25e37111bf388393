"""Streaming forms of the aggregates."""
