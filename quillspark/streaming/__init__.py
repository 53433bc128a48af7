"""Structured Streaming forms of the running state."""
