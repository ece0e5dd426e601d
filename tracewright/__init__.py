"""Trace analytics on Spark."""
