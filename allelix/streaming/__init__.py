"""Structured Streaming forms of associative operators (an addition; the batch operators define the results)."""
