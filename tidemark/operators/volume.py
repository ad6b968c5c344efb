"""Volume feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..plans.planner import Plan
from .momentum import hl2, hlc3
from .registry import P, indicator

HLCV = ("high", "low", "close", "volume")


def product(p: Plan, a: str, b: str) -> str:
    return p.expr(lambda x, y: x * y, a, b, key="product")


def money_flow_volume(p: Plan) -> str:
    """Where the close is in its bar, -1 to 1, times volume; a bar without range counts 0."""
    return p.expr(lambda h, lo, c, v: F.when(h - lo > 0, F.try_divide((c - lo) - (h - c), h - lo)).otherwise(0.0) * v, *HLCV, key="mfv")


@indicator("IND_VWAP", "volume", "W", {}, HLCV, phrases=("vwap", "volume weighted average price", "volume weighted average"))
def vwap(p: Plan):
    tp = hlc3(p)
    return p.expr(lambda a, b, c: safe_div(a, b, c), p.running("sum", product(p, tp, "volume")), p.running("sum", "volume"), p.first(tp), key="vwap")


#: The last four are what this feed was called before.
@indicator("IND_OBV", "volume", "W", {}, ("close", "volume"), phrases=("obv", "on balance volume", "on-balance volume", "volume delta", "delta volume", "cumulative delta", "order flow delta"))
def obv(p: Plan):
    return p.running("sum", p.expr(lambda d, v: F.signum(d) * v, p.change("close"), "volume", key="signed"))


@indicator("IND_AD", "volume", "W", {}, HLCV, phrases=("accumulation distribution", "accumulation/distribution", "a/d", "ad line"))
def ad(p: Plan):
    return p.running("sum", money_flow_volume(p))


@indicator("IND_VWMA", "volume", "W", {"period": P(20, 1, 400)}, ("close", "volume"), phrases=("vwma", "volume weighted moving average", "volume weighted average price"))
def vwma(p: Plan, period: int):
    return p.expr(lambda a, b, c: safe_div(a, b, c), p.sum(product(p, "close", "volume"), period), p.sum("volume", period), p.first("close"), key="vwap")


@indicator("IND_MFI", "volume", "W", {"period": P(14, 2, 200)}, HLCV, phrases=("mfi", "money flow index", "money flow"))
def mfi(p: Plan, period: int):
    """50 while the window is not full, and where nothing flowed or nothing flowed out."""
    tp = hlc3(p)
    flow, d = product(p, tp, "volume"), p.change(tp)
    up = p.sum(p.expr(lambda f, x: F.when(x > 0, f).otherwise(0.0), flow, d, key="up"), period)
    down = p.sum(p.expr(lambda f, x: F.when(x < 0, f).otherwise(0.0), flow, d, key="down"), period)
    return p.expr(lambda a, b: F.when(a + b > 0, 100 - F.lit(100.0) / (safe_div(a, b, 1.0) + 1)).otherwise(50.0), up, down, key="mfi")


@indicator("IND_CMF", "volume", "W", {"period": P(20, 2, 200)}, HLCV, phrases=("cmf", "chaikin money flow", "money flow measure"))
def cmf(p: Plan, period: int):
    return p.expr(safe_div, p.sum(money_flow_volume(p), period), p.sum("volume", period), key="div0")


@indicator("IND_KVO", "volume", "R", {"fast": P(34, 1, 200), "slow": P(55, 2, 400)}, HLCV, phrases=("klinger", "klinger volume oscillator", "kvo"))
def kvo(p: Plan, fast: int, slow: int):
    force = p.expr(lambda d, v, m: F.signum(d) * (v - m), p.change(hlc3(p)), "volume", p.mean("volume", slow), key="force")
    return p.ema(force, fast)


@indicator("IND_EOM", "volume", "W", {"length": P(14, 2, 200), "divisor": P(100.0, 1.0, 1000.0)}, ("high", "low", "volume"), phrases=("ease of movement", "eom", "ease of movement index"))
def eom(p: Plan, length: int, divisor: float):
    return p.expr(lambda d, m: F.signum(d) * F.pow(safe_div(d, m) * divisor, 2), p.change(hl2(p)), p.mean("volume", length), key=("eom", divisor))


@indicator("IND_VOLUME_OSC", "volume", "R", {"fast": P(5, 1, 100), "slow": P(10, 2, 200)}, ("volume",), ("osc", "signal"), ("volume oscillator", "volume osc", "volume oscillator signal"))
def volume_osc(p: Plan, fast: int, slow: int):
    osc = p.expr(lambda a, b: a - b, p.sum("volume", fast), p.sum("volume", slow), key="diff")
    return osc, p.ema(osc, fast)


@indicator("IND_ASI", "volume", "R", {"period": P(14, 1, 100)}, ("high", "low", "close"), ("line", "signal", "osc"), ("accumulation swing index", "asi", "swing index"))
def asi(p: Plan, period: int):
    swing = p.expr(lambda c, c1, h, h1, lo, lo1: F.when(c > c1, h - h1).when(c < c1, lo1 - lo).otherwise(0.0), "close", p.lag("close"), "high", p.lag("high"), "low", p.lag("low"), key="swing")
    line = p.ema(swing, period)
    signal = p.ema(line, period)
    return line, signal, p.expr(lambda a, b: a - b, line, signal, key="diff")
