"""Spark jobs for large panels of time-stamped bars."""

__version__ = "0.1.0"
