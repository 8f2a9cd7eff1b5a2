"""Scans and sinks built on Spark's own readers and writers."""
