"""Temporal-variability analytics on Spark: cohort, probes, completeness models, indicators."""
