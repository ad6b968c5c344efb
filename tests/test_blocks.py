"""Plans on blocks against the same plans on whole series."""

import numpy as np
import pandas as pd
import pytest
from data import flat, frame, one, walk
from pyspark.sql import functions as F
from tidemark import operators as O
from tidemark.operators import components
from tidemark.plans import ast
from tidemark.plans.blocks import number_rows
from tidemark.plans.planner import Plan

SHORT = {"IND_GARCH_11": {"burn_in": 100}, "IND_GJR_GARCH_11": {"burn_in": 100}, "IND_EGARCH_11": {"burn_in": 100}, "IND_HURST": {"period": 20}}
FEEDS = [(f, SHORT.get(O.FEEDS[f][0], {})) for f in O.feed_ids()]
NAMES = [f.lower() for f in O.feed_ids()]
DAY = "floor(ts / 37)"


def series() -> dict[str, pd.DataFrame]:
    """Long and short ones, one with values missing at the start and one with some missing later."""
    out = {"a": walk(700), "b": walk(333, seed=9, gap_p=0.1), "c": walk(5, seed=2), "d": flat(150), "e": walk(400, seed=4), "f": walk(400, seed=6)}
    out["e"].loc[:2, ["open", "high", "low", "close"]] = np.nan
    out["f"].loc[[250, 251], "close"] = np.nan
    return out


def same(spark, got, want, names, who="abcdef"):
    for s in who:
        x, y = one(got, s, *names), one(want, s, *names)
        assert x.shape == y.shape and len(x)
        for i, n in enumerate(names):
            u, v = (x, y) if x.ndim == 1 else (x[:, i], y[:, i])
            assert np.allclose(u, v, rtol=1e-8, atol=1e-8, equal_nan=True), (s, n, np.flatnonzero(~np.isclose(u, v, rtol=1e-8, atol=1e-8, equal_nan=True))[:3])


@pytest.mark.parametrize("rows", [1, 300])
def test_all_feeds(spark, rows):
    """Blocks no longer than their halo, and longer ones; days of 37 bars to begin with."""
    df = frame(spark, **series())
    same(spark, O.with_feeds(df, FEEDS, block=DAY, rows=rows).cache(), O.with_feeds(df, FEEDS).cache(), NAMES)


@pytest.mark.parametrize("feed", ["IND_MACD_HIST", "IND_VWAP", "IND_KAMA", "IND_SUPERTREND"])
def test_small_blocks(spark, feed):
    """A feed alone has a small halo, so a series has many blocks."""
    df = frame(spark, **series())
    same(spark, O.with_feeds(df, [feed], block=DAY, rows=16), O.with_feeds(df, [feed]), [feed.lower()])


def test_windows_over_machines_and_scans(spark):
    """Steps after a state machine begin new blocks; long frames; trees and components."""
    df = frame(spark, **series())

    def plan(**how):
        p = Plan(**how)
        trend = O.plan_feed(p, "IND_SUPERTREND")
        steps = {"m": p.mean(trend, 5), "e": p.ema(p.mean(trend, 5), 4), "top": p.high("high", 100), "low": p.low(p.ema("close", 9), 70), "s": p.shift(p.ema("close", 9), 3), "w": p.whole_mean("close"), "n": p.running("avg", trend), "f": p.first(p.mean("close", 1))}
        return p.run(df, steps, ("symbol", "ts"))

    same(spark, plan(block=DAY, rows=64), plan(), ["m", "e", "top", "low", "s", "w", "n", "f"])
    ids = list(components.BUILDERS)
    same(spark, components.with_components(df, ids, block=DAY, rows=64), components.with_components(df, ids), [i.replace(".", "_") for i in ids])
    tree = {"kind": "binary_op", "op": "zscore", "left": {"kind": "binary_op", "op": "ema", "left": {"kind": "transform", "id": "close"}, "right": {"kind": "literal", "id": "3"}}, "right": {"kind": "literal", "id": "20"}}
    same(spark, ast.evaluate(df, tree, block=DAY, rows=64), ast.evaluate(df, tree), ["signal"])


@pytest.mark.parametrize("n", [64, 100, 333])
def test_long_extremes(spark, n):
    a = walk(700)
    a.loc[[0, 150, 400], "high"] = np.nan
    df, p = frame(spark, a=a), Plan()
    got = one(p.run(df, {"top": p.high("high", n), "low": p.low("low", n)}, ("symbol", "ts")), "a", "top", "low")
    want = a.assign(top=a.high.rolling(n).max(), low=a.low.rolling(n).min())[["top", "low"]].to_numpy()
    assert np.allclose(got, want, equal_nan=True)
    text = p.run(df, {"top": p.high("high", n)})._jdf.queryExecution().optimizedPlan().toString()
    assert f"-{n - 1}, currentrow" not in text


def test_rows_are_numbered(spark):
    df = frame(spark, a=walk(100), b=walk(10)).withColumn("symbol", F.when(F.col("symbol") == "a", "a"))
    got = number_rows(df, ("symbol",), "ts", DAY, ("close",)).orderBy("symbol", "_row").collect()
    assert [(r._row, r.ts, r._total, r._head_close) for r in got if r.symbol is None][:2] in ([(0, 0, 10, 100.0)], [(r._row, r.ts, 10, r._head_close) for r in got if r.symbol is None][:2])
    assert [(r._row, r.ts, r._total) for r in got if r.symbol] == [(i, i, 100) for i in range(100)]


def test_no_task_holds_a_series(spark):
    """Rows are shuffled by (series, block); what is by series alone is a row per block."""
    df = frame(spark, a=walk(50))
    plan = O.with_feeds(df, ["IND_EMA", "IND_BB", "IND_VWAP", "IND_MACD"], keep=("symbol", "ts"), block=DAY)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "hashpartitioning(symbol" in line and "_block" not in line.split("hashpartitioning")[1]:
            assert "ENSURE_REQUIREMENTS" in line
    assert "REPARTITION_BY_COL" in plan and plan.count("FlatMapGroupsInArrow") >= 2
