"""Causal time-series analytics on Spark."""
