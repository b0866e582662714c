"""Leakage-safe tabular and text studies as Spark jobs."""
