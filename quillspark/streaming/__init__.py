"""Structured Streaming forms of the practice operators."""
