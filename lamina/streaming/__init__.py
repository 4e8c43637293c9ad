"""Structured Streaming versions of ordered operators."""
