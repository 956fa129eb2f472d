"""Detector options. Names and defaults are those of the engine this one stands in for."""

from __future__ import annotations

from dataclasses import dataclass, field

from metricwatch.functions.season import SLOTS, TRENDS

LOOKBACK_DAYS = {"daily": 30, "weekly": 90, "monthly": 365, "none": 30}  # fixed values
MAX_TRANSITION_MINUTES = 30
ALERT_MODES = ("full", "latest_only", "dedupe")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class DynamicsOptions:
    trend: str = "weekly"
    period_days: int | None = None
    std_dev_multiplier: float = 2.0
    transition_minutes: int = 15

    def __post_init__(self) -> None:
        _require(self.trend in TRENDS, f"unknown trend {self.trend!r}")
        _require(self.std_dev_multiplier > 0, "std_dev_multiplier must be > 0")
        _require(self.period_days is None or self.period_days > 0, "period_days must be > 0")

    @property
    def lookback_days(self) -> int:
        return self.period_days or LOOKBACK_DAYS[self.trend]

    @property
    def transition_secs(self) -> int:
        return min(self.transition_minutes, MAX_TRANSITION_MINUTES) * 60


@dataclass(frozen=True)
class LegacyBaselineOptions:
    trend: str = "daily"
    interval_mins: int = 60
    std_dev_multiplier: float | None = None
    confidence_level: float | None = None
    allow_negative_bounds: bool = False

    def __post_init__(self) -> None:
        _require(self.trend in TRENDS, f"unknown trend {self.trend!r}")
        _require(self.interval_mins > 0, "interval_mins must be > 0")
        level = self.confidence_level
        _require(level is None or 50.0 <= level <= 99.0, "confidence_level must be in 50..99")
        k = self.std_dev_multiplier
        _require(k is None or k > 0, "std_dev_multiplier must be > 0")


@dataclass(frozen=True)
class FunnelOptions:
    trend: str | None = None
    auto_trend: bool = True
    bucket_slot_secs: int = 0
    k_outer: float = 2.5
    k_inner: float = 1.5
    min_samples: int = 5
    std_dev_multiplier: float = 2.0
    enable_l2: bool = False
    periods: tuple[int, ...] = ()
    max_sparse_bucket_ratio: float = 0.3
    lookback_days: int = 90
    eval_window_secs: int = 0
    alert_output_mode: str = "full"
    profile_outlier_k: float = 3.5
    transition_minutes: int = 15
    max_missing_rate: float = 0.3
    forecast_iterations: int = 20

    def __post_init__(self) -> None:
        _require(self.trend is None or self.trend in TRENDS, f"unknown trend {self.trend!r}")
        _require(0 < self.k_inner < self.k_outer, "need 0 < k_inner < k_outer")
        _require(self.min_samples > 0, "min_samples must be > 0")
        _require(self.bucket_slot_secs in (0, *SLOTS), "bucket_slot_secs is not an allowed slot")
        _require(self.profile_outlier_k > 0, "profile_outlier_k must be > 0")
        _require(self.alert_output_mode in ALERT_MODES, "unknown alert_output_mode")

    @property
    def hampel_k(self) -> float:
        """Scrubbing is never tighter than the alert band."""
        return max(self.profile_outlier_k, self.k_outer)

    @property
    def lookback_secs(self) -> int:
        return self.lookback_days * 86_400

    @property
    def transition_secs(self) -> int:
        return min(self.transition_minutes, MAX_TRANSITION_MINUTES) * 60

    @property
    def effective_alert_mode(self) -> str:
        """Without an evaluation window every run shows every anomaly."""
        return "full" if self.eval_window_secs == 0 else self.alert_output_mode


@dataclass(frozen=True)
class OutlierOptions:
    periods: tuple[int, ...] = ()
    detect_mode: str = "lite"
    n_trees: int = 100
    sample_size: int | None = None  # rows that train a tree; a tenth of the series unless given
    max_sample_rows: int | None = None  # a bound on either, for series too long for a tenth in one task
    max_tree_depth: int | None = None
    extension_level: int | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        _require(self.detect_mode in ("lite", "full"), "detect_mode must be lite or full")
        _require(self.n_trees > 0, "n_trees must be > 0")
        _require(self.sample_size is None or self.sample_size > 0, "sample_size must be > 0")
        _require(self.max_sample_rows is None or self.max_sample_rows > 0, "max_sample_rows must be > 0")


@dataclass(frozen=True)
class ForecastOptions:
    periods: tuple[int, ...] = ()
    n_lags: int = 5
    std_dev_multiplier: float = 2.0
    allow_negative_bounds: bool = False
    max_bins: int = 255
    iterations: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    validation_share: float = 0.2  # last part of each history that decides when boosting stops; 0: all iterations
    validation_tol: float = 0.01
    seed: int = 0

    def __post_init__(self) -> None:
        _require(self.std_dev_multiplier > 0, "std_dev_multiplier must be > 0")
        _require(self.iterations > 0, "iterations must be > 0")
        _require(0 <= self.validation_share < 1, "validation_share must be in [0, 1)")


@dataclass(frozen=True)
class ClassifierOptions:
    stationarity_method: str = "both"
    adf_significance: float = 0.05
    adf_lags: int = 1
    seasonality_strength_threshold: float = 0.1
    irregular_cv_threshold: float = 0.8
    max_seasonal_period: int = 336
    min_data_length: int = 30
    acf_floor: float = 0.1
    use_periodicity: bool = True
    candidate_periods: tuple[int, ...] = field(default=(7, 24, 48, 168, 30, 52, 365))

    def __post_init__(self) -> None:
        _require(self.adf_lags in (0, 1), "adf_lags must be 0 or 1")
