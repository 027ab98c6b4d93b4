"""Structured Streaming forms of the live behaviour."""
