"""Ordered-data analytics on Spark."""
