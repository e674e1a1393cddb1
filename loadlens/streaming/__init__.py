"""Structured Streaming twins of the batch reports."""
