"""Structured Streaming forms of the ordered-state operators."""
