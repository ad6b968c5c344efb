import numpy as np
import pandas as pd
from data import frame, walk
from pyspark.sql import functions as F
from tidemark.operators import validation as V


def test_folds(spark):
    days = spark.range(200).select(F.lit("a").alias("symbol"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).alias("ts"), "id")
    got = V.purged_folds(days, purge_days=10, embargo_days=5).toPandas()
    assert len(got) == 10 * 200 and set(got.path) == set(range(10))
    first = got[got.path == 0].sort_values("id")["part"].tolist()  # tests folds 1 and 2
    assert first == ["test"] * 80 + ["dropped"] * 4 + ["train"] * 116
    apart = got[got.path == 1].sort_values("id")["part"].tolist()  # folds 1 and 3
    assert apart[40:80] == ["dropped"] * 4 + ["train"] * 27 + ["dropped"] * 9


def test_folds_by_blocks(spark):
    """The same folds whether rows are numbered in one window or by blocks; fewer rows than folds, too."""
    df = frame(spark, a=walk(203), b=walk(3), c=walk(10))
    one, other = (V.purged_folds(df, purge_days=0.0001, embargo_days=0.0001, block=b).select("symbol", "ts", "path", "part").toPandas().sort_values(["symbol", "ts", "path"], ignore_index=True) for b in (None, "floor(ts / 20)"))
    assert len(one) and one.equals(other)


def test_bootstrap_keeps_the_mean(spark):
    a = walk(300)
    got = V.block_bootstrap(frame(spark, a=a), "close", samples=2000).toPandas()
    assert len(got) == 2000 and abs(got["mean"].mean() - a.close.mean()) < 0.1 * got["mean"].std() and got["mean"].std() > 0
    assert V.block_bootstrap(frame(spark, a=a[:7]), "close", samples=5).count() == 5


def test_bands_and_thinning(spark):
    df = frame(spark, a=walk(500), b=walk(10))
    got = {r.symbol: r for r in V.bands(df, ["symbol"], "close").collect()}
    assert np.allclose([got["a"].p10, got["a"].p50, got["a"].p90], np.percentile(walk(500).close, [10, 50, 90]))
    thin = V.thin(df, "close", 50).toPandas()
    sizes = thin.groupby("symbol").size().to_dict()
    assert sizes == {"a": 50, "b": 10} and {0, 499} <= set(thin[thin.symbol == "a"].ts)
    spike = pd.DataFrame({"ts": range(300), "close": 0.0})
    spike.loc[137, "close"] = 9.0
    assert 137 in set(V.thin(frame(spark, s=spike), "close", 20).toPandas().ts)


def test_sketched_bands(spark):
    """Ranks stay within the stated bound, over many partitions, with ties, missing values and groups of any size."""
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.lognormal(size=40_000), np.repeat(1.0, 5000), [np.nan] * 100])
    rows = pd.DataFrame({"g": "big", "x": rng.permutation(values)})
    rows = pd.concat([rows, pd.DataFrame({"g": "small", "x": [3.0, 1.0, 2.0]}), pd.DataFrame({"g": "none", "x": [np.nan]})])
    got = {r.g: r for r in V.sketched_bands(spark.createDataFrame(rows).repartition(16), ["g"], "x", (0.01, 0.1, 0.5, 0.9, 0.99)).collect()}
    known = np.sort(values[np.isfinite(values)])
    assert got["big"].n == len(known) and got["none"].p50 is None and (got["small"].p50, got["small"].n) == (2.0, 3)
    for p in (0.01, 0.1, 0.5, 0.9, 0.99):
        v = got["big"][f"p{round(100 * p)}"]
        low, high = np.searchsorted(known, v, "left") / len(known), np.searchsorted(known, v, "right") / len(known)
        assert low - 0.01 <= p <= high + 0.01, (p, v, low, high)


def test_leaks(spark):
    days = spark.range(200).select(F.lit("a").alias("symbol"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("id").cast("int"))).alias("ts"), "id")
    folds = V.purged_folds(days, purge_days=10, embargo_days=10)
    day = 86_400
    assert not any(r.leakage_detected or r.n_leaks for r in V.leaks(folds, 8 * day).collect())
    assert {r.path: r.n_leaks for r in V.leaks(folds, 10 * day).collect()}[0] == 1  # folds 1 and 2: a row ten days and one after them
    twice = folds.unionByName(folds.where("part = 'test' and path = 1 and id = 90").withColumn("part", F.lit("train")))
    assert [r.path for r in V.leaks(twice, 0).collect() if r.leakage_detected] == [1]
