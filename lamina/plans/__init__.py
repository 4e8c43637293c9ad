"""Composed plans: the curation pipeline, the leakage experiment, the engine, and the registered queries."""
