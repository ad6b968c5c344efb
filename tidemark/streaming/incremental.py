"""Bars and recursive feeds over a stream.

Every feed reads only what came before, so a recursion's last value is all that a series has to keep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bars import GRANULARITIES


def stream_bars(ticks: DataFrame, symbol: str, ts: str, price: str, id: str, granularity: str = "1h", delay: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks; a bar comes out when the watermark has passed its end, later ticks are dropped."""
    value, order = F.col(price).cast("double"), F.struct(F.col(ts), F.col(id))
    grouped = ticks.withWatermark(ts, delay).groupBy(F.col(symbol).alias("symbol"), F.window(ts, GRANULARITIES[granularity]).alias("w"))
    return grouped.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").cast("double").alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_ema(bars: DataFrame, alphas: dict[str, float]) -> DataFrame:
    """(symbol, ts, close, one column per alpha): fixed-alpha scans of closes carried on from batch to batch.

    State per symbol: the last value of each scan, nothing else.  Rows of a batch count by ts; a batch is later than
    the one before it.  Missing closes count as in kernels.scan: skipped at the start, the end of all values later.
    """
    names = list(alphas)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable", ignore_index=True)
        last = list(state.get) if state.exists else None
        out = rows[["symbol", "ts", "close"]].copy()
        values = []
        for close in rows["close"].to_numpy(float, na_value=math.nan).tolist():
            if last is None and not math.isfinite(close):
                values.append([math.nan] * len(names))
                continue
            last = [close] * len(names) if last is None else [alphas[n] * close + (1 - alphas[n]) * y for n, y in zip(names, last)]
            values.append(last)
        if last is not None:
            state.update(tuple(last))
        if values:
            out[names] = values
            yield out

    fields = ", ".join(f"{n} double" for n in names)
    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandasWithState(update, f"symbol string, ts timestamp, close double, {fields}", fields, "append", "NoTimeout")
