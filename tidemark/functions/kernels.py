"""Recursions over one series, as numpy functions for a grouped map.  NaN is a missing value here."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

MEAN_ABS = math.sqrt(2 / math.pi)  # of a standard normal
LOG_LIMIT = 350.0


def _from_first(x: np.ndarray, run) -> np.ndarray:
    """run(x) on what follows a missing prefix; a value missing later makes the result missing from there on."""
    real = np.isfinite(x)
    out = np.full(len(x), np.nan)
    if real.any():
        start = int(real.argmax())
        stop = len(x) if real[start:].all() else start + int((~real[start:]).argmax())
        out[start:stop] = run(x[start:stop])
    return out


def scan(x: np.ndarray, alpha: float) -> np.ndarray:
    """y0 = x0, y = alpha x + (1 - alpha) y; alpha is clipped to [0, 1].

    Values missing at the start give missing results; one missing later leaves nothing to go on from.
    """
    alpha = min(max(float(alpha), 0.0), 1.0)
    if alpha == 0.0:
        return _from_first(x, lambda v: np.full(len(v), v[0]))
    return _from_first(x, lambda v: pd.Series(v).ewm(alpha=alpha, adjust=False).mean().to_numpy())


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return scan(x, 2.0 / (max(int(span), 1) + 1))


def rma(x: np.ndarray, length: int) -> np.ndarray:
    return scan(x, 1.0 / max(int(length), 1))


def scan_step(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """y0 = x0, y += k (x - y) with a coefficient for each bar."""
    if len(x) != len(k):
        raise ValueError("a coefficient for each bar is needed")
    out, y = np.empty(len(x)), math.nan
    for i, (v, c) in enumerate(zip(x.tolist(), np.clip(k, 0, 1).tolist())):
        y = v if i == 0 else c * v + (1 - c) * y
        out[i] = y
    return out


# A scan over consecutive pieces of a series.  Its state is (begun, y): nothing yet, a value, or nothing to go on from (NaN).


def _known(x: np.ndarray, k: float | np.ndarray) -> np.ndarray:
    return np.isfinite(x) if isinstance(k, float) else np.isfinite(x) & np.isfinite(k)


def _run(x: np.ndarray, k: float | np.ndarray) -> np.ndarray:
    return scan(x, k) if isinstance(k, float) else scan_step(x, k)


def scan_on(x: np.ndarray, k: float | np.ndarray, begun: bool = False, y: float = math.nan) -> np.ndarray:
    """The scan of x with coefficient(s) k, going on from a state."""
    known, out = _known(x, k), np.full(len(x), np.nan)
    start = 0 if begun else int(known.argmax()) if known.any() else len(x)
    rest = known[start:]
    stop = len(x) if rest.all() else start + int((~rest).argmax())
    own = k if isinstance(k, float) else k[start:stop]
    if not begun:
        out[start:stop] = _run(x[start:stop], own)
    elif math.isfinite(y):
        out[:stop] = _run(np.r_[y, x[:stop]], own if isinstance(own, float) else np.r_[1.0, own])[1:]
    return out


def scan_map(x: np.ndarray, k: float | np.ndarray) -> tuple[float, float, float, bool, bool]:
    """What a piece does to the state before it: (scale, end, fresh, some, gaps).

    A state with a value y becomes scale y + end, or NaN where the piece has gaps; one that has not begun becomes fresh (NaN after a gap) if the
    piece has some values.  These maps compose, so pieces can be looked at in any order.
    """
    known = _known(x, k)
    if not len(x):
        return 1.0, 0.0, math.nan, False, False
    scale = (1.0 - min(max(k, 0.0), 1.0)) ** len(x) if isinstance(k, float) else float(np.prod(1.0 - np.clip(k, 0, 1)))
    return scale, float(scan_on(x, k, True, 0.0)[-1]), float(scan_on(x, k)[-1]), bool(known.any()), not known.all()


def scan_after(state: tuple[bool, float], piece: tuple[float, float, float, bool, bool]) -> tuple[bool, float]:
    (begun, y), (scale, end, fresh, some, gaps) = state, piece
    if begun:
        return True, math.nan if gaps else scale * y + end
    return (True, fresh) if some else (False, math.nan)


def divide(a: np.ndarray, b: np.ndarray, fill: float = 0.0) -> np.ndarray:
    zero = b == 0
    return np.where(zero, fill, a / np.where(zero, 1.0, b))


def rsi(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """From smoothed gains and losses."""
    return np.where(down == 0, 100.0, 100.0 - 100.0 / (1.0 + divide(up, down)))


# State machines: run(state, *arrays) gives the lines of these bars and the state for the next ones; None is the state before all.


def supertrend(state: tuple | None, high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, mult: float) -> tuple[tuple[np.ndarray, ...], tuple | None]:
    """A band on either side ratchets towards price, judged by the close before; the side flips on this close."""
    width, mid = mult * atr, (high + low) / 2.0
    tops, floors = (mid + width).tolist(), (mid - width).tolist()
    line, side = np.empty(len(close)), np.empty(len(close))
    for i, c in enumerate(close.tolist()):
        if state is None:
            top, base, up = tops[i], floors[i], True
        else:
            top, base, last, up = state
            top = tops[i] if tops[i] < top or last > top else top
            base = floors[i] if floors[i] > base or last < base else base
            up = c >= base if up else c > top
        line[i], side[i] = (base, 1.0) if up else (top, -1.0)
        state = (top, base, c, bool(up))
    return (line, side), state


def psar(state: tuple | None, high: np.ndarray, low: np.ndarray, start: float, increment: float, maximum: float) -> tuple[tuple[np.ndarray, ...], tuple | None]:
    """Parabolic stop and reverse, seeded long with the first low as stop and as extreme.

    Long and short are one rule in mirrored prices: with sign -1 highs and lows change places and sign.
    """
    sar, side = np.empty(len(high)), np.empty(len(high))
    for i, (h, lo) in enumerate(zip(high.tolist(), low.tolist())):
        if state is None:
            sign, factor, extreme, stop, before = 1.0, start, lo, lo, ((h, lo), (h, lo))
        else:
            sign, factor, extreme, stop, before = state
            stop += factor * (extreme - stop)
            against, along = (lo, h) if sign > 0 else (h, lo)
            stop = sign * min(sign * stop, *(sign * b[1 if sign > 0 else 0] for b in before))
            if sign * against < sign * stop:
                sign, stop, extreme, factor = -sign, extreme, against, start
            elif sign * along > sign * extreme:
                extreme, factor = along, min(factor + increment, maximum)
            before = ((h, lo), before[0])
        sar[i], side[i] = stop, sign
        state = (sign, factor, extreme, stop, before)
    return (sar, side), state


def garch(r: np.ndarray, omega: float, alpha: float, beta: float, seed: float, gamma: float = 0.0) -> np.ndarray:
    """h0 = seed, h = omega + (alpha + gamma [r' < 0]) r'^2 + beta h', r' and h' of the bar before."""
    if not len(r):
        return np.empty(0)
    shocks = omega + np.where(r < 0, alpha + gamma, alpha) * r * r
    if 0.0 <= beta < 1.0:  # a scan of what would hold each variance where it is
        return scan(np.r_[seed, shocks[:-1] / (1.0 - beta)], 1.0 - beta)
    out, h = np.empty(len(r)), seed
    for i, shock in enumerate(np.r_[0.0, shocks[:-1]].tolist()):
        h = out[i] = shock + beta * h if i else seed
    return out


def egarch(r: np.ndarray, omega: float, alpha: float, gamma: float, beta: float, seed: float) -> np.ndarray:
    """Log variance: s = omega + beta s' + alpha z' + gamma (|z'| - E|z|), z' = r' / exp(s' / 2).  Raises if it diverges."""
    out = np.empty(len(r))
    s = math.log(max(seed, 1e-12))
    for i in range(len(r)):
        if i:
            z = r[i - 1] / math.exp(s / 2)
            s = omega + beta * s + alpha * z + gamma * (abs(z) - MEAN_ABS)
        if not abs(s) < LOG_LIMIT:
            raise ValueError(f"EGARCH diverged at bar {i}")
        out[i] = s
    return out


def egarch_line(state: tuple | None, r: np.ndarray, omega: float, alpha: float, gamma: float, beta: float, burn_in: int, annualise: float) -> tuple[tuple[np.ndarray], tuple]:
    """Annualised EGARCH volatility from log returns by bar, the first one missing.

    The seed is the variance of the first burn_in returns, and the recursion starts from it at the bar after them, so
    nothing later than a bar reaches it.  omega 0 stands for the one that makes the seed the long-run variance.
    """
    n, first, s, last, base = state or (0, (), math.nan, math.nan, omega)
    out, start, first = np.full(len(r), np.nan), max(int(burn_in), 2) + 1, list(first)
    for i, v in enumerate(r.tolist()):
        if 0 < n < start:
            first.append(v)
        elif n == start:
            s = math.log(max(float(np.var(first)), 1e-12))
            base, first = omega or s * (1 - beta), []
        elif n > start:
            z = last / math.exp(s / 2)
            s = base + beta * s + alpha * z + gamma * (abs(z) - MEAN_ABS)
        if n >= start:
            if abs(s) >= LOG_LIMIT:
                raise ValueError(f"EGARCH diverged at bar {n}")
            out[i] = math.exp(s / 2) * math.sqrt(annualise)
        n, last = n + 1, v
    return (out,), (n, tuple(first), s, last, base)


def kalman_gain(rows: np.ndarray, q: float, r: float, p0: float) -> tuple[np.ndarray, np.ndarray]:
    """Error sqrt(p) and gain of a local level at consecutive row numbers: they depend on the number only.

    p becomes (p + q) r / (p + q + r), so what many rows do to it is a power of a matrix.
    """
    error, gain = np.empty(len(rows)), np.empty(len(rows))
    p, step, n = np.array([p0, 1.0]), np.array([[r, q * r], [1.0, q + r]]), int(rows[0]) if len(rows) else 0
    while n:
        if n & 1:
            p = step @ p
            p = p / p[1]
        step, n = step @ step, n >> 1
        step = step / np.abs(step).max()
    now = float(p[0])
    for i in range(len(rows)):
        now += q
        gain[i] = now / (now + r)
        now *= 1 - gain[i]
        error[i] = math.sqrt(now)
    return error, gain


def kalman(close: np.ndarray, q: float, r: float, p0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local level: estimate, its error sqrt(p), and the gain; the first bar is the prior."""
    error, gain = kalman_gain(np.arange(len(close)), q, r, p0)
    return scan_step(close, gain), error, gain


def mcginley(state: float | None, close: np.ndarray, n: int) -> tuple[tuple[np.ndarray], float | None]:
    """md += (c - md) / max(n (c / md)^4, 1): the floor keeps a step from passing the price.  A zero md restarts there."""
    out, md = np.empty(len(close)), state
    for i, c in enumerate(close.tolist()):
        md = c if md is None or md == 0 else md + (c - md) / max(n * (c / md) ** 4, 1.0)
        out[i] = md
    return (out,), md


def hurst(x: np.ndarray, n: int) -> np.ndarray:
    """Rescaled-range exponent of each window of n, blockwise so that memory stays bounded."""
    out = np.full(len(x), np.nan)
    if len(x) < n:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, n)
    for at in range(0, len(windows), 4096):
        w = windows[at : at + 4096]
        dev = w - w.mean(axis=1, keepdims=True)
        walk = np.cumsum(dev, axis=1)
        spread, std = walk.max(axis=1) - walk.min(axis=1), dev.std(axis=1)
        flat = (w.max(axis=1) == w.min(axis=1)) | (std == 0) | (spread <= 0)
        out[at + n - 1 : at + n - 1 + len(w)] = np.where(flat, 0.5, np.log(np.where(flat, 1.0, spread / np.where(std == 0, 1.0, std))) / math.log(n))
    return out
