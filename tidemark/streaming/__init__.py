"""Structured Streaming forms of the live behaviours. Each takes and gives a streaming (or batch) DataFrame."""
