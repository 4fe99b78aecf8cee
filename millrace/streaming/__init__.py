"""Structured Streaming forms of the load and monitor operators."""
