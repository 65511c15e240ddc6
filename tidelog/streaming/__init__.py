"""Structured Streaming over logs of versions."""
