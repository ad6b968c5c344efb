import pytest
from pyspark.sql import functions as F
from tidemark.operators import rules as R
from tidemark.sources import bars as B
from tidemark.sources import fixtures as X


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, text string").orderBy("id")


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_indicators(spark):
    df = texts(spark, "reversion in quiet markets", "An Exponential Moving Average", "Williams %R, a/d", "volume weighted averages", "stoch rsi and RSI")
    assert column(df, R.detect_indicators(F.col("text"))) == [[], ["IND_EMA"], ["IND_WILLIAMS_R", "IND_AD"], ["IND_VWAP"], ["IND_STOCH_RSI"]]


def test_timeframes(spark):
    df = texts(spark, "15-minute bars", "1 hour", "30 mins", "4hrs", "a 5 d hold", "none", None, "007 days", "5 cats in 3 - 4 HOURS", "2 minx 6 min_ 8 Min.", "9  -h")
    assert column(df, R.detect_timeframe(F.col("text"), "1h")) == ["15m", "1h", "30m", "4h", "5d", "1h", "1h", "7d", "4h", "8m", "1h"]


def test_exit_clause(spark):
    df = texts(spark, "Buy. Take-Profit at 3, then exit", "exitable, existing", "in the İstanbul session EXITS at noon", "", None).withColumn("p", R.split_entry_exit(F.col("text"))).orderBy("id")
    assert column(df, "p.exit") == ["Take-Profit at 3, then exit", "", "EXITS at noon", "", ""]


def test_exit_clause_behind_wide_characters(spark):
    df = texts(spark, "\U0001f600\U0001f600 buy, exit now", "\U0001f600").withColumn("p", R.split_entry_exit(F.col("text"))).orderBy("id")
    assert column(df, "p.entry") == ["\U0001f600\U0001f600 buy, ", "\U0001f600"]
    assert column(df, "p.exit") == ["exit now", ""]


def test_phrases_in_one_pass(spark):
    """Against each phrase on its own; the text is read by one pattern, not once for each phrase."""
    import random
    import re

    random.seed(7)
    table = [("ab", 1), ("ab c", 2), ("ab cs", 3), ("b", 4), ("%r", 5), ("c d", 6), ("bs", 7), ("ab", 8), ("d(1,1)", 9)]
    some = ["".join(random.choices([p for p, _ in table] + list("abcds %,.-\u00e9Ab"), k=random.randrange(9))) for _ in range(300)]
    df = texts(spark, *some)
    want = [[v for p, v in table if re.search(rf"(?<![a-z0-9]){re.escape(p)}s?(?![a-z0-9])", x.lower())] for x in some]
    found = R.phrases_in(F.col("text"), table)
    assert column(df, F.transform(found, lambda e: e["value"])) == want
    assert "regexp_extract_all" in df.select(found)._jdf.queryExecution().analyzed().toString()


def test_ranges(spark):
    good = ["[1, 2]", "1,2", "[1, 2", "1, 2]", " [ -1.5 ,+.5 ] ", "[1,1]", "007,8"]
    bad = ["[[[1, 2", "1, 2]]]", "[1.,2.]", "[1, 2, 3]", "[1]", "1e3, 2e3", "[a, b]", "[inf, nan]", "[1_0, 2_0]", "[, ]", "[2, 1]", "(1, 2)"]
    df = texts(spark, *good, *bad)
    assert [m is None for m in column(df, R.check_cell(F.col("text"), "range"))] == [True] * len(good) + [False] * len(bad)


def test_alternates_of_a_large_catalog(spark):
    """Against the plain ranking,."""
    import random

    random.seed(5)
    rows = [(random.choice("ABC"), f"S{random.randrange(40)}", random.choice(["1m", "1h", "1d"])) for _ in range(150)]
    catalog = spark.createDataFrame(rows, "asset_class string, symbol string, granularity string")
    asked = [(f"S{i}", g) for i in range(45) for g in ("1m", "1h", "5m")]
    kind, grains = {}, {}
    for c, s, g in rows:
        kind[s] = min(c, kind.get(s, c))
        grains.setdefault(s, set()).add(g)
    want = {(a, g): min((g not in grains[s], kind[s] == kind.get(a, ""), s) for s in kind if s != a)[2] for a, g in asked}
    out = R.alternate_symbols(spark.createDataFrame(asked, "anchor string, timeframe string"), catalog)
    assert {(r.anchor, r.timeframe): r.alternate for r in out.collect()} == want
    assert R.alternate_symbols(spark.createDataFrame(asked[:2], "anchor string, timeframe string"), catalog.limit(0)).where("alternate is null").count() == 2
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_triggers_stay_in_their_clause(spark):
    df = texts(spark, "Buy when it crosses below; exit when it crosses back above.", "nothing")
    parts = df.withColumn("p", R.split_entry_exit(F.col("text"))).orderBy("id")
    assert column(parts, R.entry_primitive(F.col("p.entry"))) == ["TRIGGER_CROSS_BELOW", "TRIGGER_CROSS_ABOVE"]
    assert column(parts, R.exit_primitive(F.col("p.exit"))) == ["TRIGGER_CROSS_ABOVE", "TRIGGER_CROSS_BELOW"]


def test_audit(spark):
    df = texts(spark, "plain", "uses an LSTM", "data from Bloomberg", "Bloomberg and interest rate", "needs a GPU", "earnings", "dividend", "tick data", None)
    assert [r.status for r in R.audit(df).orderBy("id").collect()] == ["PASSED", "REJECTED", "REJECTED", "REQUIRES_HITL", "REQUIRES_HITL", "REQUIRES_HITL", "PASSED", "PASSED", "PASSED"]
    none = R.audit(df, granularities=F.array(F.lit("1m"))).orderBy("id").collect()
    assert none[7].status == "REJECTED"


def test_secondary_signal(spark):
    df = texts(spark, "a").withColumn("d", F.array(F.lit("IND_AD"), F.lit("IND_ADX")))
    assert column(df, R.secondary_signal(F.col("d"))) == ["IND_ADX_MINUS_DI"]


def test_cells(spark):
    df = texts(spark, "1.5", "x", "", "[1, 2]", "2,1", "5%", " .5 ", "1e3")
    assert [m is None for m in column(df, R.check_cell(F.col("text"), "number"))] == [True, False, False, False, False, False, True, True]
    assert [m is None for m in column(df, R.check_cell(F.col("text"), "range"))] == [False, False, False, True, False, False, False, False]
    assert [m is None for m in column(df, R.check_cell(F.col("text"), "percent"))] == [True, False, False, False, False, True, True, True]


def test_unreadable_table(spark):
    cells = spark.createDataFrame([("t", 1, 0, "x")], "table_id string, row int, col int, text string")
    assert [(r.status, r.columns) for r in R.validate_tables(cells).collect()] == [("parse-error", 0)]


def test_chunks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\nfirst words\n\nmore\n\n## Two\n\nlast")
    got = R.read_chunks(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.heading, r.text, r.tokens) for r in got] == [("One", "first words\nmore", 3), ("Two", "last", 1)]
    joined = R.join_chunks(R.read_chunks(spark, str(tmp_path)), budget=18).collect()
    assert joined[0].text == "first words\nmorela"


def test_catalog_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    assert X.read_catalog(spark, path).count() == 18
    X.write_catalog(X.catalog_seed(spark).limit(3), path)
    assert X.read_catalog(spark, path).count() == 3
    verdicts = R.check_catalog(X.requirements(spark), X.catalog_seed(spark))
    assert not R.all_available(verdicts).first()[0]


def test_bars_break_ties_by_id(spark):
    ticks = spark.createDataFrame([("a", 0, 2.0, 2), ("a", 0, 1.0, 1), ("a", 10, 5.0, 3), ("a", 20, None, 4)], "s string, t long, p double, id long").withColumn("ts", F.timestamp_seconds("t"))
    assert [tuple(r)[2:] for r in B.to_bars(ticks, "s", "ts", "p", "id", "1m").collect()] == [(1.0, 5.0, 1.0, 5.0, 3.0)]


@pytest.mark.parametrize("name", ["1s", "15m", "1d"])
def test_granularities(spark, name):
    from data import SF

    got = B.event_bars(spark, SF, name)
    assert got.count() == got.select("symbol", "ts").distinct().count()
