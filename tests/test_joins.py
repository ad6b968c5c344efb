import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidemark.operators import joins as J

DAY0 = datetime(2024, 1, 1)


def when(s):
    return None if s is None else DAY0 + timedelta(seconds=s)


@pytest.mark.parametrize("width,strict,within", [(10, False, None), (10_000, False, None), (37, True, None), (25, False, 60), (7, True, 30)])
def test_asof_by_looking(spark, width, strict, within):
    """Ties, nulls in keys and times, repeated rows, one key with most rows, buckets of any width."""
    random.seed(width)
    key = lambda: random.choice([None, "a", "b", "hot", "hot", "hot"])
    left = [(i, key(), random.choice([None, random.randrange(300)]) if i % 9 == 0 else random.randrange(300)) for i in range(200)]
    left += left[:5]
    right = [(key(), random.choice([None, *range(0, 300, 7)]), j, random.choice([None, f"v{j}"])) for j in range(150)]
    a = spark.createDataFrame([(i, k, when(t), "own") for i, k, t in left], "id int, k string, ts timestamp, _t string")
    b = spark.createDataFrame([(k, when(t), j, v) for k, t, j, v in right], "k string, at timestamp, n int, v string").repartition(3)

    def best(k, t):
        some = [(rt, j, v) for rk, rt, j, v in right if k is not None and t is not None and rk == k and rt is not None and (rt < t if strict else rt <= t)]
        rt, j, v = max(some, key=lambda x: x[:2], default=(None, None, None))
        return (j, v) if rt is not None and (within is None or t - rt <= within) else (None, None)

    got = J.asof_join(a, b, ["k"], "ts", "at", ["n", "v"], width, strict, "n", within)
    assert got.columns == ["id", "k", "ts", "_t", "n", "v"]
    say = lambda rows: sorted(map(str, rows))
    assert say((r.id, r.k, r.ts, r._t, r.n, r.v) for r in got.collect()) == say((i, k, when(t), "own", *best(k, t)) for i, k, t in left)
    assert J.asof_join(a, b.limit(0), ["k"], "ts", "at", ["n"], width).where("n is null").count() == len(left)
    assert J.asof_join(a.limit(0), b, ["k"], "ts", "at", ["n"], width).count() == 0


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_overlaps_by_looking(spark, width):
    random.seed(width)

    def spans(n):
        for i in range(n):
            a = random.choice([None, *range(200)])
            yield i, random.choice(["x", "y", None]), a, None if a is None else random.choice([None, a, a + random.randrange(40), a - 3])

    left, right = list(spans(120)), list(spans(25))
    schema = "id int, k string, s long, e long"
    got = J.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], "s", "e", width)
    meets = lambda p, q: None not in (p[1], p[2], p[3], q[2], q[3]) and p[1] == q[1] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]
    want = {p[0]: any(meets(p, q) for q in right) for p in left}
    assert {r.id: r.overlaps for r in got.collect()} == {i: w for i, w in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_late_rows_join_merge_or_drop(spark, tmp_path):
    """A row between two open sessions makes them one; one behind the watermark is dropped."""
    batches = [[("u", 0), ("u", 100)], [("u", 50), ("v", 400)], [("w", 10), ("v", 1000)], [("v", 5000)]]
    made = lambda df: J.sessions(df, ["user"], "ts", "60 seconds", F.min("ts").alias("first"))
    for k, rows in enumerate(batches):
        spark.createDataFrame([(u, when(s)) for u, s in rows], "user string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user string, ts timestamp").parquet(str(tmp_path / "in")).withWatermark("ts", "120 seconds")
        made(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.user, r.start, r.end, r.rows) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # 0, 100 and the late 50 are one session; w's row at 10 came when the watermark was at 280.
    assert got == [("u", when(0), when(160), 3), ("v", when(400), when(460), 1), ("v", when(1000), when(1060), 1)]
    whole = made(spark.createDataFrame([(u, when(s)) for rows in batches for u, s in rows], "user string, ts timestamp"))
    assert {(r.user, r.start, r.rows) for r in whole.collect()} == {(u, s, n) for u, s, _, n in got} | {("w", when(10), 1), ("v", when(5000), 1)}
