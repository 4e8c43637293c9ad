"""Readers. All have explicit schemas; nothing is inferred."""
