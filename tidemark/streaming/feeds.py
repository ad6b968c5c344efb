"""Feeds over a stream of bars: a recursion's state is kept per series, typed, and let go when a series falls silent.

Each feed is a machine, run(state, *columns), as kernels.py has them; a batch gives the values of its bars and the state
for the next batch, so values do not depend on how the stream is cut into batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import kernels as K


def scan_machine(state: list | None, x: np.ndarray, alpha: float) -> tuple[np.ndarray, list]:
    """A fixed-alpha scan; the state is (begun, last value)."""
    begun, y = state or (False, float("nan"))
    out = K.scan_on(x, float(alpha), begun, float("nan") if y is None else y)
    begun = begun or bool(np.isfinite(x).any())
    return out, [begun, float(out[-1]) if len(out) else y]


def ema(state: list | None, close: np.ndarray, span: int = 20) -> tuple[tuple[np.ndarray], list]:
    line, state = scan_machine(state, close, 2.0 / (span + 1))
    return (line,), state


def rsi(state: list | None, close: np.ndarray, period: int = 14) -> tuple[tuple[np.ndarray], list]:
    last, up, down = state or (None, None, None)
    d = np.diff(np.r_[close[0] if last is None else last, close])
    gain, up = scan_machine(up, np.maximum(d, 0.0), 1.0 / period)
    loss, down = scan_machine(down, np.maximum(-d, 0.0), 1.0 / period)
    return (K.rsi(gain, loss),), [float(close[-1]), up, down]


def macd(state: list | None, close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[tuple[np.ndarray, ...], list]:
    one, two, three = state or (None, None, None)
    a, one = scan_machine(one, close, 2.0 / (fast + 1))
    b, two = scan_machine(two, close, 2.0 / (slow + 1))
    smooth, three = scan_machine(three, a - b, 2.0 / (signal + 1))
    return (a - b, smooth, a - b - smooth), [one, two, three]


def atr(state: list | None, high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> tuple[tuple[np.ndarray], list]:
    last, mean = state or (None, None)
    before = np.r_[np.nan if last is None else last, close[:-1]]
    width = np.where(np.isnan(before), high - low, np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before))))
    line, mean = scan_machine(mean, width, 1.0 / period)
    return (line,), [float(close[-1]), mean]


def supertrend(state: list | None, high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 10, mult: float = 3.0) -> tuple[tuple[np.ndarray, ...], list]:
    width, band = state or (None, None)
    (mean,), width = atr(width, high, low, close, period)
    lines, band = K.supertrend(None if band is None else tuple(band), high, low, close, mean, mult)
    return lines, [width, list(band)]


#: Feed: its machine, the columns that it reads, its lines.
STREAMED: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {
    "IND_EMA": (ema, ("close",), ("ind_ema",)),
    "IND_RSI": (rsi, ("close",), ("ind_rsi",)),
    "IND_MACD": (macd, ("close",), ("ind_macd", "ind_macd_signal", "ind_macd_hist")),
    "IND_ATR": (atr, ("high", "low", "close"), ("ind_atr",)),
    "IND_SUPERTREND": (supertrend, ("high", "low", "close"), ("ind_supertrend", "ind_supertrend_direction")),
}


class Feeds(StatefulProcessor):
    """The feeds of one series: state is the time of the last bar and the machines' states (small lists, as JSON)."""

    def __init__(self, feeds: tuple[str, ...], silence: int | None):
        self.feeds, self.silence = feeds, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("feeds", "last timestamp, machines string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("ts", kind="stable", ignore_index=True)
        last, machines = (self.state.get()[0], json.loads(self.state.get()[1])) if self.state.exists() else (None, {})
        if last is not None:
            # What a later batch brings of times that are done cannot be counted any more.
            bars = bars[bars["ts"] > pd.Timestamp(last)].reset_index(drop=True)
        if not len(bars):
            return
        out = bars[["ts"]].copy()
        out.insert(0, "symbol", key[0])
        for feed in self.feeds:
            run, reads, lines = STREAMED[feed]
            values, machines[feed] = run(machines.get(feed), *(bars[c].to_numpy(float, na_value=np.nan) for c in reads))
            for name, line in zip(lines, values):
                out[name] = line
        self.state.update((bars["ts"].iloc[-1].to_pydatetime(), json.dumps(machines)))
        if self.silence is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(bars["ts"].iloc[-1].timestamp() * 1000) + self.silence * 1000)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_feeds(bars: DataFrame, feeds: list[str], silence: int | None = None) -> DataFrame:
    """(symbol, ts, a column per line) of a stream of bars (symbol, ts, open, high, low, close, volume).

    Bars of a batch count by ts; a bar that is not later than the series' last one is dropped.  silence: after so many
    seconds of event time without a bar (the stream needs a watermark on ts) a series' state goes, and it begins anew.
    Needs the RocksDB state store.
    """
    lines = [n for f in feeds for n in STREAMED[f][2]]
    schema = StructType.fromDDL("symbol string, ts timestamp, " + ", ".join(f"{n} double" for n in lines))
    processor = Feeds(tuple(feeds), silence)
    return bars.select("symbol", "ts", "open", "high", "low", "close", "volume").groupBy("symbol").transformWithStateInPandas(processor, schema, "append", "none" if silence is None else "eventTime")
