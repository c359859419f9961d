"""Scalar column functions. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: timings are recorded to four decimals, so a smaller spread is not measurable.
DISPERSION_FLOOR = 1e-4

DAY_SECONDS = 86_400
MAGNITUDE_STEPS = 1024
MAGNITUDE_OFFSET = 1100 * MAGNITUDE_STEPS


def q(name: str) -> Column:
    """Column by its literal name; timing columns contain dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def signed_deviation(value: Column, centre: Column, dispersion: Column) -> Column:
    return (value - centre) / dispersion


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def crossing_weight(before: Column, after: Column) -> Column:
    """Where between two samples a difference reaches zero; 0 for a zero span."""
    span = after - before
    return F.when(span == 0, F.lit(0.0)).otherwise(-before / span)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def risk_scale(log_odds: Column) -> Column:
    return 100.0 * sigmoid(log_odds)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null instead of an error or infinity when the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator)


def coefficient_of_variation(x: Column) -> Column:
    return safe_ratio(F.stddev_samp(x), F.avg(x))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as double, with the fraction kept."""
    return F.unix_micros(ts) / F.lit(1e6)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def day_slot(ts: Column, days: float = 1.0) -> Column:
    """Index of the stretch of ``days`` days a timestamp falls in."""
    return F.floor(F.unix_seconds(ts) / F.lit(DAY_SECONDS * days))


def sha256_text(parts: Sequence[Column], sep: str = ",") -> Column:
    return F.sha2(F.concat_ws(sep, *parts), 256)


def magnitude_slot(x: Column) -> Column:
    """Order-preserving integer slot of a double, about 0.07 % wide.

    Depends on the value only, so it splits a hot group into many ordered
    pieces without sampling, and is the same in every run and retry. NaN comes last.
    """
    size = F.floor(F.log2(F.abs(x)) * MAGNITUDE_STEPS) + MAGNITUDE_OFFSET
    return (
        F.when(F.isnan(x), F.lit(4 * MAGNITUDE_OFFSET))
        .when(x == 0, F.lit(0))
        .when(x == F.lit(float("inf")), F.lit(2 * MAGNITUDE_OFFSET))
        .when(x == F.lit(float("-inf")), F.lit(-2 * MAGNITUDE_OFFSET))
        .when(x > 0, size)
        .otherwise(-size)
        .cast("long")
    )
