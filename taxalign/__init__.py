"""Comparison of two versions of a named hierarchy, as Spark DataFrame jobs."""

__version__ = "0.1.0"
