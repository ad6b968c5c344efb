"""Momentum feeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import clip, safe_div
from ..plans.planner import Plan
from .registry import P, indicator

HLC = ("high", "low", "close")


def hl2(p: Plan) -> str:
    return p.expr(lambda h, lo: (h + lo) / 2, "high", "low", key="hl2")


def hlc3(p: Plan) -> str:
    return p.expr(lambda h, lo, c: (h + lo + c) / 3, *HLC, key="hlc3")


def gains(p: Plan) -> tuple[str, str]:
    d = p.change("close")
    return p.expr(lambda x: F.greatest(x, F.lit(0.0)), d, key="gain"), p.expr(lambda x: F.greatest(-x, F.lit(0.0)), d, key="loss")


def rsi_step(p: Plan, period: int) -> str:
    gain, loss = gains(p)
    return p.kernel("rsi", (p.rma(gain, period), p.rma(loss, period)), K.rsi)[0]


@indicator("IND_RSI", "momentum", "R", {"period": P(14, 2, 200)}, phrases=("rsi", "relative strength index", "relative strength"))
def rsi(p: Plan, period: int):
    return rsi_step(p, period)


@indicator("IND_STOCH", "momentum", "W", {"period": P(14, 1, 200), "smooth": P(3, 1, 50)}, HLC, ("k", "d"), ("stochastic", "stochastic oscillator", "stoch", "k and d"))
def stoch(p: Plan, period: int, smooth: int):
    k = p.stochastic_k(period)
    return k, p.mean(k, smooth)


@indicator("IND_STOCH_RSI", "momentum", "R", {"period": P(14, 2, 200)}, phrases=("stochastic rsi", "stoch rsi"))
def stoch_rsi(p: Plan, period: int):
    """Where the RSI is in its range of N bars; a range of zero reads 50 (the reference prints 5000 there)."""
    r = rsi_step(p, period)
    return p.expr(lambda x, lo, hi: safe_div(x - lo, hi - lo, 0.5) * 100, r, p.low(r, period), p.high(r, period), key="place")


@indicator("IND_CCI", "momentum", "W", {"period": P(20, 2, 200)}, HLC, phrases=("cci", "commodity channel index"))
def cci(p: Plan, period: int):
    """A mean deviation of zero gives NULL."""
    tp = hlc3(p)
    return p.expr(lambda x, m, d: F.try_divide(x - m, d * 0.015), tp, p.mean(tp, period), p.mean_dev(tp, period), key="cci")


@indicator("IND_WILLIAMS_R", "momentum", "W", {"period": P(14, 1, 200)}, HLC, phrases=("williams %r", "williams r", "williams", "%r"))
def williams_r(p: Plan, period: int):
    return p.expr(lambda k: k - 100, p.stochastic_k(period), key="less100")


@indicator("IND_ROC", "momentum", "W", {"period": P(12, 1, 400)}, phrases=("roc", "rate of change", "rate of change oscillator", "momentum"))
def roc(p: Plan, period: int):
    return p.pct_change("close", period)


@indicator("IND_AO", "momentum", "W", {"fast": P(5, 1, 100), "slow": P(34, 2, 400)}, ("high", "low"), phrases=("awesome oscillator", "ao", "awesome"))
def ao(p: Plan, fast: int, slow: int):
    x = hl2(p)
    return p.expr(lambda a, b: a - b, p.mean(x, fast), p.mean(x, slow), key="diff")


@indicator("IND_COPPOCK", "momentum", "W", {"long": P(14, 1, 200), "short": P(11, 1, 200)}, phrases=("coppock curve", "coppock"))
def coppock(p: Plan, long: int, short: int):
    return p.wma(p.expr(lambda a, b: a + b, p.pct_change("close", long), p.pct_change("close", short), key="sum"), 10)


@indicator("IND_DPO", "momentum", "W", {"period": P(21, 3, 400)}, phrases=("dpo", "detrended price oscillator"))
def dpo(p: Plan, period: int):
    return p.expr(lambda c, m: c - m, "close", p.lag(p.mean("close", period), period // 2 + 1), key="diff")


@indicator("IND_TSI", "momentum", "R", {"long": P(25, 2, 400), "short": P(13, 1, 200), "signal": P(13, 1, 200)}, phrases=("tsi", "true strength index"))
def tsi(p: Plan, long: int, short: int, signal: int):
    d = p.change("close")
    twice = lambda x: p.ema(p.ema(x, long), short)
    share = p.kernel("divide", (twice(d), twice(p.expr(F.abs, d, key="abs"))), K.divide)[0]
    return p.kernel("percent", (p.ema(share, signal),), lambda x: 100.0 * x)[0]


@indicator("IND_FISHER", "momentum", "R", {"period": P(9, 2, 100)}, ("high", "low"), phrases=("fisher transform", "fisher"))
def fisher(p: Plan, period: int):
    x = hl2(p)
    place = p.expr(lambda v, lo, hi: clip(safe_div(v - lo, hi - lo, 0.5) * 2 - 1, -0.999, 0.999), x, p.low(x, period), p.high(x, period), key="fisher")
    wave = p.expr(lambda n: F.ln((n + 1) / (1 - n)) * 0.5, place, key="wave")
    smooth = p.scan(p.expr(lambda w: w * 0.66, wave, key=("times", 0.66)), 0.5)
    return p.scan(p.kernel("fisher", (wave, smooth), lambda w, s: 0.5 * w + 0.67 * np.clip(1.67 * s, -1.9, 1.9))[0], 0.5)


@indicator("IND_CONNORS_RSI", "momentum", "R", {"period": P(3, 1, 50), "rsi_period": P(3, 2, 50), "streak": P(2, 1, 20)}, phrases=("connors rsi", "connors", "composite rsi"))
def connors_rsi(p: Plan, period: int, rsi_period: int, streak: int):
    """A short RSI plus smoothed up days less smoothed down days; ``period`` is declared but has no effect."""
    up, down = (p.rma(p.expr(lambda x: (x > 0).cast("double"), x, key="positive"), streak) for x in gains(p))
    return p.kernel("connors", (rsi_step(p, rsi_period), up, down), lambda r, a, b: r + a - b)[0]
