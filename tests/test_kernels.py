import numpy as np
import pandas as pd
import pytest
from tidemark.functions import kernels as K
from tidemark.operators import arch

X = np.random.default_rng(3).normal(size=200).cumsum()


@pytest.mark.parametrize("alpha", [0, 1 / 14, 0.1, 0.5, 1])
def test_scan_by_loop(alpha):
    y, want = X[0], []
    for i, v in enumerate(X):
        y = v if i == 0 else alpha * v + (1 - alpha) * y
        want.append(y)
    before = X.copy()
    assert np.allclose(K.scan(X, alpha), want, atol=1e-12) and (X == before).all()


def test_scan_starts_after_a_missing_prefix():
    x = np.r_[np.full(5, np.nan), X]
    assert np.isnan(K.scan(x, 0.3)[:5]).all() and np.allclose(K.scan(x, 0.3)[5:], K.scan(X, 0.3))
    assert np.isnan(K.scan(np.full(3, np.nan), 0.3)).all() and len(K.scan(np.zeros(0), 0.3)) == 0


def test_scan_step():
    k = np.random.default_rng(1).uniform(size=200)
    y, want = X[0], [X[0]]
    for v, c in zip(X[1:], k[1:]):
        y = y + c * (v - y)
        want.append(y)
    assert np.allclose(K.scan_step(X, k), want, atol=1e-12)
    with pytest.raises(ValueError):
        K.scan_step(X, k[:-1])


def test_kalman_by_loop():
    c = 100 + np.random.default_rng(11).normal(size=400).cumsum()
    x, p, rows = c[0], 1.0, []
    for v in c:
        p = p + 1e-5
        k = p / (p + 1e-3)
        x, p = x + k * (v - x), p * (1 - k)
        rows.append((x, p**0.5, k))
    assert np.allclose(np.stack(K.kalman(c, 1e-5, 1e-3, 1.0), axis=1), rows)
    assert all(len(v) == 0 for v in K.kalman(np.zeros(0), 1e-5, 1e-3, 1.0))


def returns(model: str, n: int = 6000) -> np.ndarray:
    rng, out = np.random.default_rng(11), np.empty(n)
    p = {"garch": (1e-5, 0.08, 0.90, 0.0), "gjr": (1e-5, 0.05, 0.85, 0.12)}.get(model)
    h = p[0] / (1 - p[1] - p[2] - p[3] / 2) if p else np.exp(-0.45 / 1.85)
    s = np.log(h)
    for t in range(n):
        z = rng.standard_normal()
        out[t] = np.sqrt(h) * z
        if p:
            h = p[0] + (p[1] + (p[3] if out[t] < 0 else 0)) * out[t] ** 2 + p[2] * h
        else:
            s = -0.45 - 0.85 * s + 0.12 * z + 0.15 * (abs(z) - K.MEAN_ABS)
            h = np.exp(s)
    return out


@pytest.mark.parametrize("model,truth,tol", [("garch", {"alpha": 0.08, "beta": 0.90}, 0.03), ("gjr", {"alpha": 0.05, "beta": 0.85, "gamma": 0.12}, 0.04), ("egarch", {"alpha": 0.12, "gamma": 0.15, "beta": -0.85}, 0.05)])
def test_fit_recovers(model, truth, tol):
    got = arch.fit(returns(model), model)
    assert got["converged"]
    for name, value in truth.items():
        assert abs(got[name] - value) < tol, (name, got)


def test_fit_refuses():
    with pytest.raises(ValueError):
        arch.fit(np.zeros(100))
    with pytest.raises(ValueError):
        arch.fit(np.zeros(1000), "arch")


def test_forecast_goes_to_the_long_run(spark):
    row = {"model": "garch", "omega": 1e-5, "alpha": 0.08, "beta": 0.9, "gamma": None, "last_variance": 2e-4, "last_return": 0.01, "annualise": 252.0}
    fits = spark.createDataFrame([row], "model string, omega double, alpha double, beta double, gamma double, last_variance double, last_return double, annualise double")
    path = arch.forecast_arch(fits, 500).orderBy("step").toPandas()["volatility"]
    assert len(path) == 501 and path[0] == pytest.approx(np.sqrt(252 * 2e-4)) and path[500] == pytest.approx(np.sqrt(252 * 1e-5 / 0.02), rel=1e-3)


def test_egarch_raises_when_it_diverges():
    with pytest.raises(ValueError):
        K.egarch(np.r_[np.full(10, 1e-9), np.full(50, 5.0)], 0.0, 3.0, 5.0, -0.99, 1e-18)


def test_forecast_refuses_an_unusable_fit(spark):
    fits = spark.createDataFrame([("egarch", -0.4, 0.1, -0.8, 0.1, float("nan"), 0.01, 252.0)], "model string, omega double, alpha double, beta double, gamma double, last_variance double, last_return double, annualise double")
    with pytest.raises(Exception, match="no usable last variance"):
        arch.forecast_arch(fits, 2).collect()


def test_fit_per_series(spark):
    r = returns("garch", 900)
    pdf = pd.concat([pd.DataFrame({"symbol": "long", "ts": range(901), "close": 100 * np.exp(np.r_[0, r].cumsum())}), pd.DataFrame({"symbol": "short", "ts": range(50), "close": 100.0})])
    got = arch.fit_arch(spark.createDataFrame(pdf), burn_in=200).collect()
    assert [r.symbol for r in got] == ["long"] and got[0].n == 700
