"""Metric anomaly detection over many series at once, written as Spark plans."""

__version__ = "0.1.0"
