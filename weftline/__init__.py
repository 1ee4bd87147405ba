"""Recommendation data jobs and training-data operators for Spark."""
