"""Chunked-array analytics on Spark."""
