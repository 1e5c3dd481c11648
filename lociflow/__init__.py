"""Spark-first variant-evidence analytics: every operator maps DataFrames to a DataFrame."""
