"""Structured Streaming forms of the time-windowed operators."""
