"""Fitting conditional-volatility models, and forecasts from a fit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

PENALTY = 1e12
NAMES = {"garch": ("omega", "alpha", "beta"), "gjr": ("omega", "alpha", "beta", "gamma"), "egarch": ("omega", "alpha", "gamma", "beta")}
#: Starting coefficients, omega in units of the sample's variance (for EGARCH: derived from it).
START = {"garch": (0.1, 0.08, 0.85), "gjr": (0.1, 0.05, 0.80, 0.08), "egarch": (None, 0.05, 0.10, -0.6)}
FIT = "model string, n long, converged boolean, log_likelihood double, omega double, alpha double, beta double, gamma double, persistence double, unconditional_vol double, last_variance double, last_return double, annualise double"


def variances(model: str, r: np.ndarray, p: dict[str, float], seed: float) -> np.ndarray:
    if model == "egarch":
        return np.exp(K.egarch(r, p["omega"], p["alpha"], p["gamma"], p["beta"], seed))
    return K.garch(r, p["omega"], p["alpha"], p["beta"], seed, p.get("gamma", 0.0))


def nelder_mead(f, start: np.ndarray, rounds: int, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """The usual simplex search; whether the simplex shrank below tol."""
    n = len(start)
    simplex = np.vstack([start, *(start + np.eye(n)[i] * (0.25 * abs(start[i]) or 0.1) for i in range(n))])
    values = np.array([f(x) for x in simplex])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        simplex, values = simplex[order], values[order]
        if abs(values[-1] - values[0]) <= tol * (abs(values[0]) + tol) and np.abs(simplex[1:] - simplex[0]).max() < 1e-5:
            return simplex[0], values[0], True
        centre = simplex[:-1].mean(axis=0)
        reach = lambda t, worst=simplex[-1], centre=centre: centre + t * (worst - centre)
        x, v = reach(-1.0), f(reach(-1.0))
        if v < values[0]:
            y = reach(-2.0)
            x, v = min(((x, v), (y, f(y))), key=lambda t: t[1])
        elif v >= values[-2]:
            y = reach(-0.5 if v < values[-1] else 0.5)
            w = f(y)
            if w >= min(v, values[-1]):
                simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
                values[1:] = [f(s) for s in simplex[1:]]
                continue
            x, v = y, w
        simplex[-1], values[-1] = x, v
    best = int(values.argmin())
    return simplex[best], values[best], False


def fit(returns: np.ndarray, model: str = "garch", burn_in: int = 500, rounds: int = 600, annualise: float = 252.0) -> dict:
    """Gaussian quasi-maximum likelihood on what follows the burn-in; missing returns are left out.

    A fit on the edge of what is allowed, or stopped early, is returned with converged False.  Fewer than burn_in + 50
    returns, or an unknown model, raise.  It sees the whole series, which is why it is no feed.
    """
    if model not in NAMES:
        raise ValueError(f"unknown model {model}")
    r = np.asarray(returns, float)
    r, burn_in = r[np.isfinite(r)], max(int(burn_in), 100)
    if len(r) < burn_in + 50:
        raise ValueError(f"{len(r)} returns are fewer than {burn_in + 50}")
    seed, tail = float(np.var(r[:burn_in])), r[burn_in:]
    scale = float(np.var(tail)) or 1e-12
    names, start = NAMES[model], list(START[model])
    if model == "egarch":
        start[0] = math.log(max(scale, 1e-12)) * (1 - start[3])

    def params(x: np.ndarray) -> dict[str, float]:
        p = dict(zip(names, map(float, x)))
        return p if model == "egarch" else p | {"omega": p["omega"] * scale}

    def allowed(p: dict[str, float]) -> bool:
        if model == "egarch":
            return -0.999 < p["beta"] < 0
        return p["omega"] > 1e-8 * scale and min(p["alpha"], p["beta"], p.get("gamma", 0.0)) >= 0 and p["alpha"] + p["beta"] + p.get("gamma", 0.0) / 2 < 1

    def loss(x: np.ndarray) -> float:
        p = params(x)
        if not allowed(p):
            return PENALTY
        try:
            h = variances(model, tail, p, seed)
        except (ValueError, OverflowError):
            return PENALTY
        value = 0.5 * float(np.sum(np.log(h) + tail * tail / h))
        return value if math.isfinite(value) else PENALTY

    x, value, done = nelder_mead(loss, np.array(start, float), rounds)
    x, value, done = nelder_mead(loss, x, rounds)  # again from there: a collapsed simplex starts afresh
    p = params(x)
    if model == "egarch":
        persistence, long_run = abs(p["beta"]), math.exp(min(p["omega"] / (1 - p["beta"]), 300))
    else:
        persistence, long_run = p["alpha"] + p["beta"] + p.get("gamma", 0.0) / 2, p["omega"] / (1 - p["beta"])
    last = float(variances(model, tail, p, seed)[-1]) if value < PENALTY else math.nan
    edge = value >= PENALTY or (model != "egarch" and (min(p["alpha"], p["beta"]) < 1e-6 or persistence > 0.9999))
    return {"model": model, "n": len(tail), "converged": bool(done and not edge), "log_likelihood": -value, **{k: p.get(k) for k in ("omega", "alpha", "beta", "gamma")}, "persistence": persistence, "unconditional_vol": math.sqrt(long_run * annualise), "last_variance": last, "last_return": float(tail[-1]), "annualise": float(annualise)}


def fit_arch(df: DataFrame, model: str = "garch", close: str = "close", keys: tuple[str, ...] = ("symbol",), order: str = "ts", burn_in: int = 500, annualise: float = 252.0) -> DataFrame:
    """A fit per series of prices, one row each; a series that is too short gives none."""

    def run(series: pd.DataFrame) -> pd.DataFrame:
        price = np.maximum(series.sort_values(order, kind="stable")[close].to_numpy(float), 1e-12)
        r = np.diff(np.log(price))
        head = {k: series[k].iloc[0] for k in keys}
        if np.isfinite(r).sum() < max(burn_in, 100) + 50:
            return pd.DataFrame(columns=[*keys, *[c.split()[0] for c in FIT.split(", ")]])
        return pd.DataFrame([head | fit(r, model, burn_in, annualise=annualise)])

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), FIT])
    return df.select(*keys, order, close).groupBy(*keys).applyInPandas(run, schema)


def forecast_arch(fits: DataFrame, h: int) -> DataFrame:
    """(step 0 to h, volatility) rows for each fit, annualised; step 0 is the last observed.  Columns only, no Python.

    An unusable last variance raises.
    """
    e, step = F.col, F.col("step").cast("double")
    gamma = F.coalesce(e("gamma"), F.lit(0.0))
    usable = F.when(F.isnan("last_variance") | e("last_variance").isNull() | (e("last_variance") <= 0), F.raise_error(F.concat(F.lit("no usable last variance: "), e("model")))).otherwise(e("last_variance"))
    z = e("last_return") / F.sqrt(usable)
    log_first = e("omega") + e("beta") * F.ln(usable) + e("alpha") * z + gamma * (F.abs(z) - K.MEAN_ABS)
    mu = e("omega") / F.greatest(1 - e("beta"), F.lit(1e-12))
    egarch = F.exp(mu + F.pow(e("beta"), step) * (log_first - mu))
    gjr = F.when(e("model") == "gjr", gamma).otherwise(0.0)
    first = e("omega") + (e("alpha") + F.when(e("last_return") < 0, gjr).otherwise(0.0)) * F.pow(e("last_return"), 2) + e("beta") * usable
    decay = e("alpha") + e("beta") + gjr / 2
    level = e("omega") / F.greatest(1 - decay, F.lit(1e-12))
    garch = level + F.pow(decay, step - 1) * (first - level)
    variance: Column = F.when(step == 0, usable).when(e("model") == "egarch", egarch).otherwise(garch)
    rows = fits.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(max(int(h), 1)))))
    return rows.withColumn("volatility", F.sqrt(F.greatest(variance, F.lit(0.0)) * e("annualise"))).select(*[c for c in fits.columns if c not in FIT_ONLY], "model", "step", "volatility")


FIT_ONLY = {c.split()[0] for c in FIT.split(", ")}
