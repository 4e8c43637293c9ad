"""Leakage-aware curation of datasets whose rows are correlated inside groups, on Spark."""
