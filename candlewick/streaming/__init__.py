"""Structured Streaming forms of the bar and book jobs."""
