"""A fixed-alpha scan of a series that is too long for one task: one step of a plan on blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..plans.planner import Plan


def blocked_scan(df: DataFrame, value: str, alpha: float, block: Column | str, out: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts", rows: int = 65_536) -> DataFrame:
    """df with ``out``, the scan y0 = x0, y = alpha x + (1 - alpha) y of ``value`` within ``keys`` by ``order``.

    ``block`` must not fall as ``order`` rises.  Missing values count as in kernels.scan: at the start they give missing
    results, one later makes all that follows missing.  Rows are shuffled by (keys, block); only a row per block meets in
    a task per series.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is within (0, 1]")
    plan = Plan(keys, order, block, rows)
    return plan.run(df, {out: plan.scan(value, alpha)}, tuple(c for c in df.columns if c != out))
