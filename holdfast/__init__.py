"""Customer churn, value and retention analytics on Spark DataFrames."""

PERIODS = (6, 7, 8)
"""Suffixes of the three monthly snapshots, oldest first; the last is the prediction point."""
