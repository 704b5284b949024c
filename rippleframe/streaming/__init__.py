"""Structured Streaming forms of the batch operators (an addition; the batch engine does not need them)."""
