"""Structured Streaming forms of the windowed functions."""
