"""All registered queries; importing this package fills the registry."""

from metricwatch.catalog import classify, dynamics, ensemble, files, funnel, outliers, prepare, results, statistics, streams
from metricwatch.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "classify", "dynamics", "ensemble", "files", "funnel", "outliers", "prepare", "results", "statistics", "streams"]
