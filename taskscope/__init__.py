"""Trace analytics and workload preparation for large task campaigns on Spark."""

__version__ = "0.1.0"
