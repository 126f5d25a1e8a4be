"""Structured Streaming forms of the node's continuous operators."""
