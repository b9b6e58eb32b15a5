"""Structured Streaming forms of the stateful constructs."""
