"""Scalar idioms of the engine as Column expressions.  A missing value is NULL everywhere, never NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ratios are floored here before a logarithm.
LOG_FLOOR = 1e-12


def safe_div(a: Column, b: Column, fill: float | Column = 0.0) -> Column:
    """a / b; fill where b is zero (even if a is missing); NULL where b is."""
    fill = fill if isinstance(fill, Column) else F.lit(float(fill))
    return F.when(b.isNull(), F.lit(None)).when(b == 0, fill).otherwise(F.try_divide(a, b))


def floor_at(x: Column, least: float) -> Column:
    """max(x, least) that keeps NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(least))))


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b): a zero b reads as no change, and the ratio is floored."""
    return F.ln(floor_at(safe_div(a, b, 1.0), LOG_FLOOR))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def median_price() -> Column:
    return (F.col("high") + F.col("low")) / 2


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often make names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))
