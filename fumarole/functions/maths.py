"""Numeric expressions. Null in, null out, unless a fill value is named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_nan(c: Column) -> Column:
    """NaN as null, so that null is the only missing marker."""
    return F.when(~F.isnan(c), c)


def floor_at(c: Column, low: float) -> Column:
    """``max(c, low)``; ``greatest`` alone would turn null into ``low``."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(low))))


def safe_log1p(c: Column) -> Column:
    return F.log1p(floor_at(c, 0.0))


def safe_divide(n: Column, d: Column, fill: float = 0.0) -> Column:
    """``n / d`` with ``fill`` for a zero or null operand and for NaN or infinity."""
    q = F.try_divide(n, d)
    unusable = q.isNull() | F.isnan(q) | (F.abs(q) == F.lit(float("inf")))
    return F.when(unusable, F.lit(float(fill))).otherwise(q)


def clip(c: Column, lo: Column, hi: Column) -> Column:
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def back_transform(log_value: Column) -> Column:
    """Log-scale prediction to the original scale, never below zero."""
    return F.greatest(F.expm1(log_value), F.lit(0.0))


def round_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def share_of(part: Column, total: Column) -> Column:
    """Percentage of a total, null when the total is zero."""
    return F.try_divide(part, total) * 100


def confidence_band(confidence: Column) -> Column:
    pct = confidence * 100
    return F.when(pct >= 70, "high").when(pct >= 40, "medium").otherwise("low")
