import numpy as np
import pytest
from data import flat, frame, one, walk
from tidemark import operators as O
from tidemark.plans.planner import Plan

SHORT = {"IND_GARCH_11": {"burn_in": 100}, "IND_GJR_GARCH_11": {"burn_in": 100}, "IND_EGARCH_11": {"burn_in": 100}}
LOOSE = {"IND_CCI", "IND_RCI"}
FEEDS = [(f, SHORT.get(O.FEEDS[f][0], {})) for f in O.feed_ids()]
NAMES = [f.lower() for f in O.feed_ids()]


@pytest.fixture(scope="module")
def results(spark):
    a, b = walk(300), walk(300, seed=9, gap_p=0.1)
    both = O.with_feeds(frame(spark, a=a, b=b), FEEDS).cache()
    prefix = O.with_feeds(frame(spark, a=a[:180]), FEEDS)
    return a, {s: one(both, s, *NAMES) for s in "ab"}, one(prefix, "a", *NAMES), one(O.with_feeds(frame(spark, b=b), FEEDS), "b", *NAMES)


def test_all_there():
    assert len(O.INDICATORS) == 53 and len(O.FEEDS) == 83


def test_length_and_missing_only_at_the_start(results):
    _, out, _, _ = results
    for values in out.values():
        assert values.shape == (300, len(NAMES))
        for i, name in enumerate(NAMES):
            known = np.isfinite(values[:, i])
            assert known.any(), name
            assert known[known.argmax() :].all(), name


def test_later_bars_change_nothing(results):
    _, out, prefix, _ = results
    assert np.allclose(out["a"][:180], prefix, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_series_do_not_mix(results):
    _, out, _, alone = results
    assert np.allclose(out["b"], alone, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_warmups(results):
    _, out, _, _ = results
    first = {n: int(np.isfinite(out["a"][:, i]).argmax()) for i, n in enumerate(NAMES)}
    want = {"ind_sma": 19, "ind_ema": 0, "ind_hma": 22, "ind_cci": 38, "ind_dpo": 31, "ind_stoch_d": 15, "ind_vol_yang_zhang": 20, "ind_hurst": 99, "ind_mfi": 0, "ind_coppock": 9, "ind_garch_11": 101, "ind_kvo": 54}
    assert {k: first[k] for k in want} == want


def test_range_estimators_by_loop(spark, results):
    a, out, _, _ = results
    h, lo, o, c = (a[x].to_numpy() for x in ("high", "low", "open", "close"))
    t, n = 150, 20
    s = slice(t - n + 1, t + 1)
    park = np.sqrt(252 * np.mean(np.log(h[s] / lo[s]) ** 2) / (4 * np.log(2)))
    gk = np.sqrt(252 * np.mean(0.5 * np.log(h[s] / lo[s]) ** 2 - (2 * np.log(2) - 1) * np.log(c[s] / o[s]) ** 2))
    night, day = np.log(o[1:] / c[:-1])[t - n : t], np.log(c[s] / o[s])
    rs = np.log(h[s] / c[s]) * np.log(h[s] / o[s]) + np.log(lo[s] / c[s]) * np.log(lo[s] / o[s])
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    yz = np.sqrt(252 * (night.var() + k * day.var() + (1 - k) * rs.mean()))
    for name, value in (("ind_vol_parkinson", park), ("ind_vol_garman_klass", gk), ("ind_vol_yang_zhang", yz)):
        assert out["a"][t, NAMES.index(name)] == pytest.approx(value, rel=1e-9)


def test_flat_series(spark):
    out = O.with_feeds(frame(spark, f=flat()), ["IND_RSI", "IND_STOCH", "IND_STOCH_RSI", "IND_ZSCORE", "IND_CCI", "IND_MFI", "IND_HURST", "IND_BB_UPPER", "IND_KALMAN"])
    last = one(out, "f", *[c for c in out.columns if c.startswith("ind_")])[-1]
    assert np.allclose(last, [100, 50, 50, 0, np.nan, 50, 0.5, 100, 100], equal_nan=True)


def test_missing_values_keep_windows_empty(spark):
    a = walk(40)
    a.loc[25, "close"] = np.nan
    got = one(O.with_feeds(frame(spark, a=a), [("IND_SMA", {"period": 5})]), "a", "ind_sma")
    assert np.isnan(got[25:30]).all() and np.isfinite(got[[24, 30]]).all()


@pytest.mark.parametrize("bad", [{"period": 0}, {"period": 501}, {"period": 2.5}, {"span": 3}, {"period": "x"}, {"period": True}])
def test_parameters_are_refused(bad):
    with pytest.raises(ValueError):
        O.bind_params(O.INDICATORS["IND_SMA"], bad)


def test_missing_input_and_unknown_feed(spark):
    df = frame(spark, a=walk(5)).drop("volume")
    with pytest.raises(ValueError, match="volume"):
        O.with_feeds(df, ["IND_OBV"])
    with pytest.raises(KeyError):
        O.with_feeds(df, ["IND_NONE"])


@pytest.mark.parametrize("bad", [{"omega": 0.0}, {"alpha": 0.5, "beta": 0.5}])
def test_unstable_coefficients(spark, bad):
    with pytest.raises(ValueError):
        O.with_feeds(frame(spark, a=walk(5)), [("IND_GARCH_11", bad)])


def test_one_grouped_map_for_many_recursions(spark):
    df = O.with_feeds(frame(spark, a=walk(5)), ["IND_EMA", "IND_RSI", "IND_ADX", "IND_TSI", "IND_PSAR", "IND_MACD", "IND_KALMAN"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1


def test_windows_need_no_python(spark):
    df = O.with_feeds(frame(spark, a=walk(5)), ["IND_BB", "IND_CCI", "IND_HMA", "IND_MFI", "IND_OBV"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") <= 1


def test_steps_are_shared():
    p = Plan()
    O.plan_feed(p, "IND_ATR")
    before = len(p.known)
    O.plan_feed(p, "IND_ATR")
    assert len(p.known) == before


def test_phrases_are_longest_first():
    sizes = [len(phrase) for phrase, _ in O.phrase_table()]
    assert sizes == sorted(sizes, reverse=True)
