"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q(c: Column | str, digits: int = 6) -> Column:
    """Quantise to `digits` decimals; the odd offset keeps exact ties away from the rounding edge."""
    scale = float(10**digits)
    return F.floor(col(c).cast("double") * F.lit(scale) + F.lit(0.537)).cast("double") / F.lit(scale)


def q_sql(expr: str, digits: int = 6) -> str:
    """The same quantisation as SQL text."""
    scale = f"1e{digits}"
    return f"(CAST(floor(CAST(({expr}) AS DOUBLE) * {scale} + 0.537) AS DOUBLE) / {scale})"


def finite(c: Column | str) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def lookup_interpolate(x: Column, table: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation on an ascending (x, y) table, clamped at both ends."""
    first, last = table[0], table[-1]
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= first[0], F.lit(first[1]))
    for (x0, y0), (x1, y1) in zip(table, table[1:]):
        out = out.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) / F.lit(x1 - x0) * F.lit(y1 - y0))
    return out.otherwise(F.lit(last[1]))


def lookup_interpolate_sql(x: str, table: Sequence[tuple[float, float]]) -> str:
    first, last = table[0], table[-1]
    parts = [f"WHEN {x} IS NULL THEN NULL", f"WHEN {x} <= {first[0]!r} THEN {first[1]!r}"]
    for (x0, y0), (x1, y1) in zip(table, table[1:]):
        parts.append(
            f"WHEN {x} <= {x1!r} THEN {y0!r}::DOUBLE + ({x} - ({x0!r})::DOUBLE) "
            f"/ ({x1 - x0!r})::DOUBLE * ({y1 - y0!r})::DOUBLE"
        )
    return "(CASE " + " ".join(parts) + f" ELSE {last[1]!r} END)"


# Coefficients of the Abramowitz-Stegun 7.1.26 error function approximation.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.signum(x) * (F.lit(1.0) - poly * F.exp(-z * z))
    return F.lit(0.5) * (F.lit(1.0) + erf)


def normal_cdf_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * {z}))"
    poly = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly} + ({a})::DOUBLE) * {t})"
    return f"(0.5::DOUBLE * (1.0::DOUBLE + sign({x}) * (1.0::DOUBLE - {poly} * exp(-{z} * {z}))))"


# Two-sided confidence level (percent) to normal multiplier.
CONFIDENCE_TABLE = (
    (50.0, 0.67), (55.0, 0.76), (60.0, 0.84), (65.0, 0.93), (70.0, 1.04), (75.0, 1.15),
    (80.0, 1.28), (85.0, 1.44), (90.0, 1.64), (95.0, 1.96), (96.0, 2.05), (97.0, 2.17),
    (98.0, 2.33), (99.0, 2.58),
)


def confidence_multiplier(level: Column) -> Column:
    """Multiplier of the standard deviation for a confidence level in percent; NULL means 95."""
    return lookup_interpolate(F.coalesce(level, F.lit(95.0)), CONFIDENCE_TABLE)
