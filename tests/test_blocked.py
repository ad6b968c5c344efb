import numpy as np
import pytest
from data import frame, one, walk
from pyspark.sql import functions as F
from tidemark.functions.kernels import scan
from tidemark.operators.blocked import blocked_scan


@pytest.mark.parametrize("alpha", [0.02, 0.5, 1.0])
def test_same_as_one_scan(spark, alpha):
    """Also with values missing at the start, in the first block and in a later one."""
    series = {"a": walk(300), "b": walk(170, seed=3), "c": walk(90, seed=4), "d": walk(60, seed=5)}
    series["b"].loc[[0, 1, 120], "close"] = np.nan
    series["c"].loc[[0, 20], "close"] = np.nan
    series["d"]["close"] = np.nan
    series["d"].loc[[50, 51, 52, 53], "close"] = 5.0
    got = blocked_scan(frame(spark, **series), "close", alpha, F.floor(F.col("ts") / 37), "y", rows=37)
    for name, bars in series.items():
        want = scan(bars["close"].to_numpy(), alpha)
        assert np.allclose(one(got, name, "y"), want, rtol=1e-12, equal_nan=True), name
        assert name == "a" or np.isnan(want).any() and np.isfinite(want).any()


def test_gaps_mean_the_same_everywhere(spark):
    """The kernel, the SQL and a loop: [missing, 1, missing, 3] is missing but for its second value."""
    import duckdb
    from tidemark.plans import reference_sql as R

    x = [None, 1.0, 2.0, None, 3.0]
    want = [None, 1.0, 1.5, None, None]
    sql = f"SELECT {R.scan('x', '0.5')} AS y FROM (SELECT 'a' AS symbol, unnest(range(5)) AS ts, unnest([NULL, 1.0, 2.0, NULL, 3.0]::DOUBLE[]) AS x) t ORDER BY ts"
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == want
    assert [None if np.isnan(v) else v for v in scan(np.array(x, float), 0.5)] == want


def test_refused(spark):
    with pytest.raises(ValueError):
        blocked_scan(frame(spark, a=walk(5)), "close", 0.0, F.lit(0), "y")
