"""Scoped evidence analytics on Spark."""
