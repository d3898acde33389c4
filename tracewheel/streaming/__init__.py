"""Structured Streaming: a trace that arrives in pieces."""
