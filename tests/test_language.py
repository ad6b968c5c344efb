import numpy as np
import pytest
from data import flat, frame, one, walk
from tidemark.catalog import TREES, binary, number, series, unary
from tidemark.operators import components as C
from tidemark.operators import sweep
from tidemark.plans import ast

CLOSE = series("close")


@pytest.mark.parametrize("tree", TREES.values(), ids=TREES)
def test_trees_are_valid(tree):
    assert ast.validate(tree) and ast.unresolved(tree) == []


def nested(n: int) -> dict:
    tree = CLOSE
    for _ in range(n):
        tree = unary("abs", tree)
    return tree


@pytest.mark.parametrize("bad", [
    {"kind": "operand", "id": "close"}, {**CLOSE, "extra": 1}, {"kind": "unary_op", "op": "abs", "left": CLOSE, "right": CLOSE}, {"kind": "binary_op", "op": "add", "left": CLOSE},
    {"kind": "unary_op", "op": "exp", "left": CLOSE}, {"kind": "data_stream", "symbol": "X", "granularity": "2h"}, nested(8), {"kind": "unary_op", "op": "abs", "left": None}, 3,
])
def test_refused(bad):
    with pytest.raises(ValueError):
        ast.validate(bad)


def test_depth_limit():
    assert ast.validate(nested(7)) and ast.depth(nested(7)) == 8


def test_ids():
    assert ast.unresolved(binary("add", series("spread"), {"kind": "indicator", "id": "close"})) == ["spread", "close"]
    assert ast.unresolved(number(-1)) == ["-1"]


def test_look_ahead(spark):
    tree = binary("lag", CLOSE, number(-2))
    assert ast.look_ahead(tree) == ["lag(-2)"] and ast.look_ahead(TREES["planted"]) == []
    with pytest.raises(ValueError):
        ast.evaluate(frame(spark, a=walk(5)), tree)


def test_self_check(spark):
    ast.self_check(spark, TREES["planted"])
    with pytest.raises(ValueError):
        ast.self_check(spark, TREES["sma"])


def test_old_names_and_params(spark):
    bars = frame(spark, a=walk(60))
    old = one(ast.evaluate(bars, {"kind": "indicator", "id": "IND_ATR"}, {"atr_period": 5}), "a", "signal")
    new = one(ast.evaluate(bars, {"kind": "indicator", "id": "IND_ATR"}, {"period": 5}), "a", "signal")
    assert np.allclose(old, new)
    assert np.isfinite(one(ast.evaluate(bars, {"kind": "indicator", "id": "IND_VOLUME_DELTA"}), "a", "signal")).all()
    with pytest.raises(ValueError):
        ast.evaluate(bars, TREES["feed"], {"atr_period": 5})


def test_components_on_a_flat_series(spark):
    out = C.with_components(frame(spark, f=flat(60)), list(C.BUILDERS))
    last = one(out, "f", "entry_ema_cross", "entry_vwap_band", "exit_atr_stop", "exit_time_exit", "sizing_atr_scaled", "sizing_fractional")
    assert np.allclose(last[-1], [0, 0, 4, 1, 0.01, 0.01]) and np.allclose(last[:, :2], 0)


def test_cross_and_breakout(spark):
    jump, rise = flat(200), flat(200)
    jump.loc[100:, ["open", "high", "low", "close"]] += 100
    rise.loc[100:, "close"] += 0.5 * np.arange(100)
    got = C.with_components(frame(spark, jump=jump, rise=rise), ["entry.ema_cross", "entry.vwap_band"])
    assert one(got, "jump", "entry_ema_cross")[100] == 1 and one(got, "rise", "entry_vwap_band")[100:].max() == 1


def test_manifest(tmp_path):
    path = str(tmp_path / "m.json")
    own = C.Component("entry.own", "Own", "entry", ("X",), ast=TREES["planted"])
    assert C.append_manifest(path, own) and not C.append_manifest(path, own)
    assert C.resolve("entry.own", path) == own and [c.id for c in C.by_pillar("entry", path)] == ["entry.ema_cross", "entry.own", "entry.vwap_band"]
    assert [c.id for c in C.matching("IND_ATR")] == ["exit.atr_stop", "sizing.atr_scaled"]


def test_grid(spark):
    g = sweep.pillar_grid(C.CURATED[0])
    assert g["fast"] == {"default": 10.0, "lo": 1.0, "hi": 100.0, "step": 19.8}
    rows = sweep.grid(spark, C.CURATED[0])
    assert rows.count() == 36 and rows.select("fast", "slow").distinct().count() == 36
    with pytest.raises(ValueError):
        sweep.grid(spark, C.CURATED[0], most=10)


def test_synthesis(spark, tmp_path):
    path = str(tmp_path / "m.json")
    C.synthesize_component(spark, TREES["planted"], "entry.own", "entry", path)
    C.generate_from_primitive(spark, "IND_RSI", "entry", path)
    out = C.with_components(frame(spark, a=walk(60)), ["entry.own", "entry.ind_rsi", "exit.time_exit"], manifest=path)
    assert np.isfinite(one(out, "a", "entry_own", "entry_ind_rsi", "exit_time_exit")).all()
    for bad in (TREES["sma"], series("spread"), binary("lag", CLOSE, number(-1))):
        with pytest.raises(ValueError):
            C.synthesize_component(spark, bad, "entry.bad", "entry", path)
    assert C.resolve("entry.bad", path) is None
