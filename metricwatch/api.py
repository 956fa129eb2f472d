"""Detectors by name: each takes points of all series and gives one result table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from metricwatch.options import DynamicsOptions, ForecastOptions, FunnelOptions, OutlierOptions
from metricwatch.plans.dynamics import detect_dynamics
from metricwatch.plans.forecast import detect_forecast
from metricwatch.plans.funnel import detect_funnel
from metricwatch.plans.outlier import detect_outliers

DEFAULT_HISTORY_SECS = 7 * 86_400

DETECTORS: dict[str, tuple[type, Callable[..., DataFrame]]] = {
    "dynamics": (DynamicsOptions, detect_dynamics),
    "forecast": (ForecastOptions, detect_forecast),
    "funnel": (FunnelOptions, detect_funnel),
    "outlier": (OutlierOptions, lambda current, history, options: detect_outliers(current, options)),
}


def detect(name: str, current: DataFrame, history: DataFrame | None = None, **options: object) -> DataFrame:
    """Run a detector with the given option fields. Outliers need no history."""
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}, expected one of {sorted(DETECTORS)}")
    kind, run = DETECTORS[name]
    if history is None and name != "outlier":
        raise ValueError(f"{name} needs history")
    return run(current, history, kind(**options))
