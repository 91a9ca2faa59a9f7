"""Structured Streaming twins of batch queries."""
