"""The signal language: validated trees, planned onto the steps that feeds use.

A node is a dict.  Leaves: {"kind": "data_stream", "symbol", "granularity"}, {"kind": "literal" | "indicator" |
"transform", "id"}.  Inner nodes: {"kind": "unary_op" | "binary_op", "op", "left", "right"}.  Nothing else is allowed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import floor_at, safe_div
from ..operators.registry import FEEDS, INDICATORS, OHLCV, plan_feed
from .planner import Plan

MAX_DEPTH = 8
OPERATORS = ("zscore", "ema", "sma", "lag", "returns", "abs", "log", "ratio", "add", "sub", "mul", "div")
GRANULARITIES = ("tick", "1s", "1m", "5m", "15m", "1h", "1d")
#: Names from before, still understood.
OLD_FEEDS = {"IND_VOLUME_DELTA": "IND_OBV"}
OLD_PARAMS = {"IND_ATR": {"atr_period": "period"}}
_LEAVES = {"data_stream": {"kind", "symbol", "granularity"}, "literal": {"kind", "id"}, "indicator": {"kind", "id"}, "transform": {"kind", "id"}}


def depth(node: dict | None) -> int:
    if not isinstance(node, dict):
        return 0
    return 1 + max(depth(node.get("left")), depth(node.get("right"))) if "op" in node else 1


def validate(node: object) -> dict:
    """The node, if its kinds, keys, operators, arity and depth are right; else ValueError."""
    if isinstance(node, str):
        node = json.loads(node)
    if not isinstance(node, dict):
        raise ValueError("a node is a dict")
    kind = node.get("kind")
    if kind in _LEAVES:
        if set(node) != _LEAVES[kind]:
            raise ValueError(f"{kind} has the keys {', '.join(sorted(_LEAVES[kind]))} and no other")
        if kind == "data_stream":
            if node["granularity"] not in GRANULARITIES or not isinstance(node["symbol"], str):
                raise ValueError("a data_stream has a symbol and a known granularity")
        elif not isinstance(node["id"], str):
            raise ValueError("an id is a string")
        return node
    if kind not in ("unary_op", "binary_op"):
        raise ValueError(f"unknown kind {kind!r}")
    if extra := set(node) - {"kind", "op", "left", "right"}:
        raise ValueError(f"unknown keys {', '.join(sorted(extra))}")
    if node.get("op") not in OPERATORS:
        raise ValueError(f"unknown operator {node.get('op')!r}")
    if (kind == "binary_op") != (node.get("right") is not None):
        raise ValueError(f"{kind} has {'two operands' if kind == 'binary_op' else 'one operand'}")
    validate(node.get("left"))
    if kind == "binary_op":
        validate(node["right"])
    if depth(node) > MAX_DEPTH:
        raise ValueError(f"deeper than {MAX_DEPTH}")
    return node


def unresolved(node: dict, indicators: set[str] | None = None, series: set[str] = frozenset(OHLCV)) -> list[str]:
    """Ids that name nothing: an indicator must be one; other operands may be a series or an unsigned number as well."""
    known = set(FEEDS) if indicators is None else set(indicators)
    if "op" in node:
        return unresolved(node["left"], known, series) + (unresolved(node["right"], known, series) if node.get("right") else [])
    if node["kind"] == "data_stream":
        return []
    id = node["id"]
    number = id.replace(".", "", 1).isdigit()
    fits = id in known if node["kind"] == "indicator" else id in known or id in series or number
    return [] if fits else [id]


def look_ahead(node: object) -> list[str]:
    """Operators that reach into the future: lag or returns by a negative literal."""
    if not isinstance(node, dict):
        return []
    right, found = node.get("right"), []
    if node.get("op") in ("lag", "returns") and isinstance(right, dict) and right.get("kind") == "literal" and float(right["id"]) < 0:
        found = [f"{node['op']}({float(right['id']):g})"]
    return found + look_ahead(node.get("left")) + look_ahead(right)


def primitive_ids(node: object) -> set[str]:
    """Indicator and transform ids in a tree."""
    if not isinstance(node, dict):
        return set()
    own = {node["id"]} if node.get("kind") in ("indicator", "transform") and node.get("id") else set()
    return own | primitive_ids(node.get("left")) | primitive_ids(node.get("right"))


def _feed(plan: Plan, id: str, params: dict) -> str:
    if id in OHLCV:
        return id
    id = OLD_FEEDS.get(id, id)
    if id not in FEEDS:
        raise ValueError(f"unknown feed {id}")
    renamed = {OLD_PARAMS.get(FEEDS[id][0], {}).get(k, k): v for k, v in params.items()}
    return plan_feed(plan, id, renamed)


def _window(node: dict | None, default: int) -> int:
    """The right operand of a windowed operator; only a literal says how long."""
    if node is None:
        return default
    if node["kind"] != "literal":
        raise ValueError("the window of an operator is a literal")
    return int(float(node["id"]))


def plan_node(plan: Plan, node: dict, params: dict) -> str:
    """The step of a validated tree."""
    kind = node["kind"]
    if kind == "data_stream":
        name = node["symbol"].lower()
        return name if name in OHLCV else "close"
    if kind == "literal":
        value = float(node["id"])
        return plan.col(("literal", value), (), lambda: F.lit(value))
    if kind in ("indicator", "transform"):
        return _feed(plan, node["id"], params)
    op, left, right = node["op"], plan_node(plan, node["left"], params), node.get("right")
    if op == "ema":
        return plan.ema(left, _window(right, 20))
    if op == "sma":
        n = _window(right, 20)
        return left if n == 1 else plan.mean(left, n)
    if op == "zscore":
        n = _window(right, 20)
        score = lambda x, m, s: F.coalesce((x - m) / F.when(s == 0, 1.0).otherwise(s), F.lit(0.0))
        return plan.expr(score, left, plan.mean(left, n), plan.std(left, n), key="ast zscore")
    if op in ("lag", "returns"):
        n = _window(right, 1)
        if n < 0:
            raise ValueError(f"{op} by {n} looks ahead")
        before = plan.shift(left, n)
        return before if op == "lag" else plan.expr(lambda x, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(x, b)) - 1, left, before, key="ast returns")
    if op == "abs":
        return plan.expr(F.abs, left, key="abs")
    if op == "log":
        return plan.expr(lambda x: F.ln(floor_at(x, 1e-12)), left, key="ast log")
    if right is None:
        if op == "ratio":
            return left
        raise ValueError(f"{op} has two operands")
    other = plan_node(plan, right, params)
    make = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": safe_div, "ratio": safe_div}[op]
    return plan.expr(make, left, other, key=("ast", "div" if op == "ratio" else op))


def evaluate(df: DataFrame, tree: object, params: dict | None = None, out: str = "signal", keys: tuple[str, ...] = ("symbol",), order: str = "ts", block: Column | str | None = None, rows: int = 65_536) -> DataFrame:
    """df with the value of a tree (dict or JSON) in ``out``; params go to every feed in it, so all must know them."""
    plan = Plan(keys, order, block, rows)
    return plan.run(df, {out: plan_node(plan, validate(tree), params or {})})


def self_check(spark, tree: object, params: dict | None = None) -> None:
    """Raise unless a tree gives a finite value at each of 200 bars of a fixed frame."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    frame = pd.DataFrame({c: 100 + rng.standard_normal(200) for c in OHLCV}).assign(symbol="check", ts=range(200))
    got = evaluate(spark.createDataFrame(frame), tree, params).select("signal").toPandas()["signal"].to_numpy(float, na_value=np.nan)
    if len(got) != 200 or not np.isfinite(got).all():
        raise ValueError("the signal is not finite at every bar")


def inputs_of(ids: set[str]) -> set[str]:
    """OHLCV columns that feeds need."""
    return {c for i in ids if i in FEEDS for c in INDICATORS[FEEDS[i][0]].requires}
