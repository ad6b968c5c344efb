"""Statistical feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import safe_div
from ..plans.planner import Plan
from .registry import P, indicator


@indicator("IND_ZSCORE", "stats", "W", {"period": P(20, 2, 400)}, phrases=("z score", "z-score", "zscore", "standard score", "standard deviation score"))
def zscore(p: Plan, period: int):
    return p.expr(lambda c, m, s: safe_div(c - m, s), "close", p.mean("close", period), p.std("close", period), key="zscore")


@indicator("IND_HURST", "stats", "W", {"period": P(100, 10, 1000)}, phrases=("hurst exponent", "hurst", "hurst exponent ratio"))
def hurst(p: Plan, period: int):
    return p.kernel(("hurst", period), ("close",), lambda x: K.hurst(x, period), back=period - 1)[0]


@indicator("IND_RCI", "stats", "W", {"period": P(9, 2, 200)}, phrases=("rank correlation index", "rci", "rank correlation", "percent rank"))
def rci(p: Plan, period: int):
    """Percent of the window's other closes that are below the last one (the documented rank)."""
    return p.col(("rci", period), ("close",), lambda: F.when(F.count("close").over(p.frame(period)) == period, F.size(F.filter(F.collect_list("close").over(p.frame(period)), lambda x: x < F.col("close"))) * 100.0 / (period - 1)), period - 1)
