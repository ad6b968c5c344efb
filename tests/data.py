"""Bars for tests."""

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def walk(n: int, vol: float = 0.01, gap_p: float = 0.0, seed: int = 5, steps: int = 64) -> pd.DataFrame:
    """Path-consistent bars: high and low are the extremes of the walk that makes the bar."""
    rng = np.random.default_rng(seed)
    rows, level = [], np.log(100.0)
    for t in range(n):
        if gap_p and rng.random() < gap_p:
            level += rng.normal(0, 3 * vol)
        path = np.exp(level + np.r_[0.0, np.cumsum(rng.normal(0, vol / np.sqrt(steps), steps))])
        rows.append((t, path[0], path.max(), path.min(), path[-1], 1e6 * rng.uniform(0.5, 1.5)))
        level = np.log(path[-1])
    return pd.DataFrame(rows, columns=["ts", "open", "high", "low", "close", "volume"])


def flat(n: int = 120) -> pd.DataFrame:
    return pd.DataFrame({"ts": range(n), "open": 100.0, "high": 101.0, "low": 99.0, "close": 100.0, "volume": 500.0})


def frame(spark, **series: pd.DataFrame):
    """Bars of several series, rows in mixed order."""
    every = pd.concat([s.assign(symbol=name) for name, s in series.items()])
    return spark.createDataFrame(every.sample(frac=1.0, random_state=1))


def one(df, symbol: str, *columns: str) -> np.ndarray:
    pdf = df.where(f"symbol = '{symbol}'").select("ts", *columns).toPandas().sort_values("ts")
    out = pdf[list(columns)].to_numpy(float, na_value=np.nan)
    return out[:, 0] if len(columns) == 1 else out
