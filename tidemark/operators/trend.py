"""Trend feeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import safe_div
from ..plans.planner import ROW, Plan
from .registry import P, indicator

HLC = ("high", "low", "close")
minus = np.subtract


@indicator("IND_SMA", "trend", "W", {"period": P(20, 1, 500)}, phrases=("sma", "simple moving average", "moving average"))
def sma(p: Plan, period: int):
    return "close" if period == 1 else p.mean("close", period)


@indicator("IND_EMA", "trend", "R", {"span": P(20, 1, 500)}, phrases=("ema", "exponential moving average"))
def ema(p: Plan, span: int):
    return p.ema("close", span)


@indicator("IND_WMA", "trend", "W", {"period": P(20, 1, 500)}, phrases=("wma", "weighted moving average", "linearly weighted average"))
def wma(p: Plan, period: int):
    return p.wma("close", period)


@indicator("IND_HMA", "trend", "W", {"period": P(20, 2, 500)}, phrases=("hma", "hull moving average"))
def hma(p: Plan, period: int):
    half, root = max(period // 2, 1), max(int(period**0.5), 1)
    return p.wma(p.expr(lambda a, b: 2 * a - b, p.wma("close", half), p.wma("close", period), key="hull"), root)


@indicator("IND_KAMA", "trend", "R", {"period": P(10, 1, 200), "fast": P(2, 1, 50), "slow": P(30, 2, 200)}, phrases=("kama", "kaufman adaptive moving average", "adaptive moving average"))
def kama(p: Plan, period: int, fast: int, slow: int):
    moved = p.expr(F.abs, p.change("close"), key="abs")
    quick, lazy = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def constant(c, then, path):
        ratio = F.coalesce(safe_div(F.abs(c - then), path), F.lit(0.0))
        return F.least(F.greatest(F.pow(ratio * (quick - lazy) + lazy, 2), F.lit(0.0)), F.lit(1.0))

    k = p.expr(constant, "close", p.shift("close", period), p.sum(moved, period), key=("kama", fast, slow))
    return p.scan_step("close", k)


@indicator("IND_MACD", "trend", "R", {"fast": P(12, 1, 200), "slow": P(26, 2, 400), "signal": P(9, 1, 100)}, lines=("macd", "signal", "hist"), phrases=("macd", "moving average convergence divergence"))
def macd(p: Plan, fast: int, slow: int, signal: int):
    line = p.kernel("less", (p.ema("close", fast), p.ema("close", slow)), minus, sums=True)[0]
    smooth = p.ema(line, signal)
    return line, smooth, p.kernel("less", (line, smooth), minus)[0]


@indicator("IND_ADX", "trend", "R", {"period": P(14, 2, 200)}, HLC, ("adx", "plus_di", "minus_di"), ("adx", "average directional index", "directional index", "plus di"))
def adx(p: Plan, period: int):
    up, down = p.change("high"), p.expr(lambda x: -x, p.change("low"), key="neg")
    one_way = lambda a, b: F.when((a > b) & (a > 0), a).otherwise(0.0)
    tr = p.expr(lambda t, before: F.when(before.isNull(), 0.0).otherwise(t), p.true_range(), p.lag("close"), key="tr0")
    width = p.rma(tr, period)
    lines = [p.kernel("of range", (p.rma(x, period), width), lambda x, t: 100.0 * x / np.where(t > 0, t, 1.0))[0] for x in (p.expr(one_way, up, down, key="dm"), p.expr(one_way, down, up, key="dm"))]
    apart = p.kernel("apart", tuple(lines), lambda a, b: 100.0 * K.divide(np.abs(a - b), a + b))[0]
    return p.rma(apart, period), *lines


@indicator("IND_DONCHIAN", "trend", "W", {"period": P(20, 1, 500)}, ("high", "low"), ("middle", "upper", "lower"), ("donchian", "donchian channel", "price channel"))
def donchian(p: Plan, period: int):
    hi, lo = p.high("high", period), p.low("low", period)
    return p.expr(lambda a, b: (a + b) / 2, hi, lo, key="mid"), hi, lo


@indicator("IND_KELTNER", "trend", "R", {"period": P(20, 2, 400), "atr_period": P(10, 1, 200), "mult": P(2.0, 0.1, 10.0)}, HLC, ("middle", "upper", "lower"), ("keltner", "keltner channel"))
def keltner(p: Plan, period: int, atr_period: int, mult: float):
    mid, atr = p.ema("close", period), p.rma(p.true_range(), atr_period)
    return mid, p.expr(lambda m, a: m + a * mult, mid, atr, key=("band", mult)), p.expr(lambda m, a: m - a * mult, mid, atr, key=("band", -mult))


@indicator("IND_SUPERTREND", "trend", "S", {"period": P(10, 1, 200), "mult": P(3.0, 0.1, 20.0)}, HLC, ("line", "direction"), ("supertrend", "super trend"))
def supertrend(p: Plan, period: int, mult: float):
    atr = p.rma(p.true_range(), period)
    return p.machine(("supertrend", atr, mult), (*HLC, atr), lambda state, h, lo, c, a: K.supertrend(state, h, lo, c, a, mult), 2)


@indicator("IND_PSAR", "trend", "S", {"start": P(0.02, 0.001, 0.2), "increment": P(0.02, 0.0, 0.2), "maximum": P(0.2, 0.01, 1.0)}, ("high", "low"), ("sar", "reverse"), ("psar", "parabolic sar", "stop and reverse", "parabolic"))
def psar(p: Plan, start: float, increment: float, maximum: float):
    return p.machine(("psar", start, increment, maximum), ("high", "low"), lambda state, h, lo: K.psar(state, h, lo, start, increment, maximum), 2)


# Known by name only in the reference; built from their public definitions.  Periods are the usual textbook ones.


@indicator("IND_DEMA", "trend", "R", {"span": P(20, 1, 500)}, phrases=("dema", "double exponential moving average"))
def dema(p: Plan, span: int):
    one = p.ema("close", span)
    return p.kernel("dema", (one, p.ema(one, span)), lambda a, b: 2 * a - b)[0]


@indicator("IND_TEMA", "trend", "R", {"span": P(20, 1, 500)}, phrases=("tema", "triple exponential moving average"))
def tema(p: Plan, span: int):
    one = p.ema("close", span)
    two = p.ema(one, span)
    return p.kernel("tema", (one, two, p.ema(two, span)), lambda a, b, c: 3 * a - 3 * b + c)[0]


@indicator("IND_TRIX", "trend", "R", {"span": P(15, 1, 500)}, phrases=("trix", "triple exponential average"))
def trix(p: Plan, span: int):
    """One-bar change in percent of the triple EMA; 0 at the first bar."""
    three = p.ema(p.ema(p.ema("close", span), span), span)
    return p.kernel("step in percent", (three,), lambda x: 100.0 * (K.divide(x, np.r_[x[:1], x[:-1]], 1.0) - 1.0), back=1)[0]


@indicator("IND_MCGINLEY", "trend", "S", {"period": P(14, 1, 500)}, phrases=("mcginley", "mcginley dynamic"))
def mcginley(p: Plan, period: int):
    return p.machine(("mcginley", period), ("close",), lambda state, c: K.mcginley(state, c, period))[0]


#: Guppy's published short and long spans are 3, 5, 8, 10, 12, 15 and 30, 35, 40, 45, 50, 60; eight lines are addressable.
GUPPY = (3, 5, 8, 30, 35, 40, 45, 50)


@indicator("IND_GMMA", "trend", "R", {}, lines=("short1", "short2", "short3", "long1", "long2", "long3", "long4", "long5"), phrases=("gmma", "guppy", "guppy multiple moving average"))
def gmma(p: Plan):
    return tuple(p.ema("close", n) for n in GUPPY)


@indicator("IND_ICHIMOKU", "trend", "W", {"tenkan": P(9, 1, 200), "kijun": P(26, 1, 400), "senkou": P(52, 1, 500)}, HLC, ("tenkan", "kijun", "senkou_a", "senkou_b", "chikou"), ("ichimoku", "ichimoku cloud"))
def ichimoku(p: Plan, tenkan: int, kijun: int, senkou: int):
    """Not displaced: every line stands at the bar it is known at, so chikou is the close."""
    mid = lambda n: p.expr(lambda a, b: (a + b) / 2, p.high("high", n), p.low("low", n), key="mid")
    t, k = mid(tenkan), mid(kijun)
    return t, k, p.expr(lambda a, b: (a + b) / 2, t, k, key="mid"), mid(senkou), "close"


@indicator("IND_KALMAN", "trend", "S", {"process": P(1e-5, 1e-12, 1.0), "measurement": P(1e-3, 1e-12, 10.0)}, lines=("line", "error", "gain"), phrases=("kalman", "kalman filter"))
def kalman(p: Plan, process: float, measurement: float):
    error, gain = p.kernel(("kalman", process, measurement), (ROW,), lambda rows: K.kalman_gain(rows, process, measurement, 1.0), 2)
    return p.scan_step("close", gain), error, gain
