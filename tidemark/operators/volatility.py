"""Volatility feeds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import floor_at, log_ratio
from ..plans.planner import Plan
from .registry import P, indicator

HLC = ("high", "low", "close")
YEAR = P(252, 1, 4000)


def annual(p: Plan, variance: str, year: int) -> str:
    return p.expr(lambda v: F.sqrt(floor_at(v, 0.0) * year), variance, key=("annual", year))


def atr_step(p: Plan, period: int) -> str:
    return p.rma(p.true_range(), period)


@indicator("IND_BB", "volatility", "W", {"period": P(20, 2, 500), "mult": P(2.0, 0.1, 10.0)}, lines=("middle", "upper", "lower"), phrases=("bollinger", "bollinger bands", "bollinger band", "bb"))
def bb(p: Plan, period: int, mult: float):
    mid, dev = p.mean("close", period), p.std("close", period)
    return mid, p.expr(lambda m, s: m + s * mult, mid, dev, key=("band", mult)), p.expr(lambda m, s: m - s * mult, mid, dev, key=("band", -mult))


@indicator("IND_ATR", "volatility", "R", {"period": P(14, 1, 200)}, HLC, phrases=("atr", "average true range", "true range"))
def atr(p: Plan, period: int):
    return atr_step(p, period)


@indicator("IND_HV", "volatility", "W", {"period": P(20, 2, 400), "annualise": YEAR}, phrases=("historical volatility", "hv", "realized volatility", "realised volatility"))
def hv(p: Plan, period: int, annualise: int):
    r = p.expr(log_ratio, "close", p.shift("close"), key="logret")
    return p.expr(lambda s: s * math.sqrt(annualise), p.std(r, period), key=("times", annualise))


@indicator("IND_VOL_PARKINSON", "volatility", "W", {"period": P(20, 2, 500), "annualise": YEAR}, ("high", "low"), phrases=("parkinson", "parkinson volatility", "high-low estimator", "high low volatility"))
def parkinson(p: Plan, period: int, annualise: int):
    x = p.expr(lambda h, lo: F.pow(log_ratio(h, lo), 2) / (4 * math.log(2)), "high", "low", key="parkinson")
    return annual(p, p.mean(x, period), annualise)


@indicator("IND_VOL_GARMAN_KLASS", "volatility", "W", {"period": P(20, 2, 500), "annualise": YEAR}, ("high", "low", "open", "close"), phrases=("garman-klass", "garman klass", "garman-klass volatility", "garman"))
def garman_klass(p: Plan, period: int, annualise: int):
    x = p.expr(lambda h, lo, o, c: F.pow(log_ratio(h, lo), 2) * 0.5 - F.pow(log_ratio(c, o), 2) * (2 * math.log(2) - 1), "high", "low", "open", "close", key="gk")
    return annual(p, p.mean(x, period), annualise)


@indicator("IND_VOL_YANG_ZHANG", "volatility", "W", {"period": P(20, 2, 500), "annualise": YEAR}, ("high", "low", "open", "close"), phrases=("yang-zhang", "yang zhang", "yang-zhang volatility", "yangzhang"))
def yang_zhang(p: Plan, period: int, annualise: int):
    k = 0.34 / (1.34 + (period + 1) / (period - 1))
    night = p.expr(log_ratio, "open", p.lag("close"), key="logret")
    day = p.expr(log_ratio, "close", "open", key="logret")
    rs = p.expr(lambda h, lo, o, c: log_ratio(h, c) * log_ratio(h, o) + log_ratio(lo, c) * log_ratio(lo, o), "high", "low", "open", "close", key="rs")
    total = p.expr(lambda a, b, c: a + b * k + c * (1 - k), p.roll("var_pop", night, period), p.roll("var_pop", day, period), p.mean(rs, period), key=("yz", period))
    return annual(p, total, annualise)


def check_stationary(model: str, omega: float, alpha: float, beta: float, gamma: float = 0.0) -> None:
    """Raise for coefficients whose variance does not settle."""
    if model == "egarch":
        if not -1 < beta < 0:
            raise ValueError("egarch needs -1 < beta < 0")
        return
    if omega <= 0:
        raise ValueError(f"{model} needs omega > 0")
    if min(alpha, beta) < 0 or gamma < 0:
        raise ValueError(f"{model} needs coefficients that are not negative")
    if alpha + beta + gamma / 2 >= 1:
        raise ValueError(f"{model} needs a persistence below 1, not {alpha + beta + gamma / 2:g}")


def _returns(p: Plan) -> str:
    return p.expr(log_ratio, "close", p.lag("close"), key="logret")


def _variance_line(p: Plan, omega: float, alpha: float, beta: float, gamma: float, annualise: int, burn_in: int):
    """Annualised volatility of h = omega + (alpha + gamma [r' < 0]) r'^2 + beta h', r' and h' of the bar before.

    h begins, at the bar after the burn-in, with the variance of the first burn_in returns, so nothing later than a bar
    reaches it.  It is a scan with coefficient 1 - beta of the variances that each shock alone would hold it at.  A return
    missing in the burn-in leaves nothing to begin with.
    """
    r, n = _returns(p), max(int(burn_in), 2)
    early = p.expr(lambda x, i: F.when(i.between(1, n), x), r, p.place(), key=("first", n))
    count, total, squares = p.running("count", early), p.running("sum", early), p.running("sum", p.expr(lambda x: x * x, early, key="square"))
    shock = p.expr(lambda x: F.when(x < 0, alpha + gamma).otherwise(alpha) * x * x + omega, r, key=("shock", omega, alpha, gamma))

    def held(row, k, s, q, before):
        seed = F.greatest(q / n - F.pow(s / n, 2), F.lit(0.0))
        return F.when(k == n, F.when(row == n + 1, seed).when(row > n + 1, before / (1 - beta)))

    h = p.scan(p.expr(held, p.place(), count, total, squares, p.lag(shock), key=("held", n, beta)), 1 - beta)
    return p.kernel(("annual", annualise), (h,), lambda x: np.sqrt(np.maximum(x, 0.0)) * math.sqrt(annualise))[0]


ARCH = {"annualise": YEAR, "burn_in": P(500, 100, 20000)}


@indicator("IND_GARCH_11", "volatility", "R", {"omega": P(1e-6, 0.0, 1.0), "alpha": P(0.1, 0.0, 1.0), "beta": P(0.88, 0.0, 1.0), **ARCH}, phrases=("garch", "garch(1,1)", "garch 1,1", "arch model"))
def garch(p: Plan, omega: float, alpha: float, beta: float, annualise: int, burn_in: int):
    check_stationary("garch", omega, alpha, beta)
    return _variance_line(p, omega, alpha, beta, 0.0, annualise, burn_in)


@indicator("IND_GJR_GARCH_11", "volatility", "S", {"omega": P(1e-6, 0.0, 1.0), "alpha": P(0.05, 0.0, 1.0), "beta": P(0.85, 0.0, 1.0), "gamma": P(0.1, 0.0, 1.0), **ARCH}, phrases=("gjr-garch", "gjr garch", "gjr-garch(1,1)", "leverage garch"))
def gjr(p: Plan, omega: float, alpha: float, beta: float, gamma: float, annualise: int, burn_in: int):
    check_stationary("gjr", omega, alpha, beta, gamma)
    return _variance_line(p, omega, alpha, beta, gamma, annualise, burn_in)


@indicator("IND_EGARCH_11", "volatility", "S", {"omega": P(0.0, -500.0, 100.0), "alpha": P(0.05, -5.0, 5.0), "gamma": P(0.1, -5.0, 5.0), "beta": P(-0.6, -0.999, 0.0), **ARCH}, phrases=("egarch", "egarch(1,1)", "egarch 1,1", "exponential garch"))
def egarch(p: Plan, omega: float, alpha: float, gamma: float, beta: float, annualise: int, burn_in: int):
    """omega 0 stands for the one that makes the burn-in's variance the long-run one."""
    check_stationary("egarch", omega, alpha, beta)
    settings = (omega, alpha, gamma, beta, burn_in, annualise)
    return p.machine(("egarch", *settings), (_returns(p),), lambda state, r: K.egarch_line(state, r, *settings))[0]


@indicator("IND_CHANDELIER", "volatility", "R", {"period": P(22, 1, 200), "mult": P(3.0, 0.1, 20.0)}, HLC, ("long", "short"), ("chandelier exit", "chandelier"))
def chandelier(p: Plan, period: int, mult: float):
    """Extremes are those of the whole history, not of N bars."""
    a = atr_step(p, period)
    return p.expr(lambda x, w: x - w * mult, p.running("max", "high"), a, key=("band", -mult)), p.expr(lambda x, w: x + w * mult, p.running("min", "low"), a, key=("band", mult))
