"""Grouped-sample analytics on Spark."""
