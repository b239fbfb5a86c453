"""Structured Streaming jobs; the rules are the column functions of the batch operators."""
