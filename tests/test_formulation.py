from pyspark.sql import functions as F
from tidemark.plans import formulation as B
from tidemark.sources import fixtures as X

def test_specs(spark):
    papers = spark.createDataFrame([("p", "Long when price crosses above the EMA on 15 minute bars; exit when it falls below.", "", "btcusdt", "1h", [["HIGH_SESSION_SENSITIVITY"]]), ("q", "x", "", "QQQ", "1h", []), ("r", "VWAP", None, "ADAUSDT", "1d", [])], "paper_id string, mechanism string, hypothesis string, symbol string, granularity string, tags array<array<string>>")
    got = {(r.paper_id, r.tier): r for r in B.compile_specs(papers, X.catalog_seed(spark)).collect()}
    assert sorted(got) == [("p", t) for t in B.TIERS] + [("r", B.TIERS[0]), ("r", B.TIERS[2]), ("r", B.TIERS[3])]
    p = got["p", B.TIERS[1]]
    assert (p.timeframe, p.indicators, p.filter_primitives, p.entry_trigger_primitive) == ("15m", ["IND_EMA"], ["FLT_TIME_OF_DAY"], "TRIGGER_CROSS_ABOVE")
    assert got["p", B.TIERS[2]].target_asset == "ADAUSDT" and got["r", B.TIERS[3]].secondary_signal == "IND_AD"


def specs(spark, *rows):
    return spark.createDataFrame([r for r in rows], B.SPEC_FIELDS)


AHEAD = '{"kind":"binary_op","op":"lag","left":{"kind":"transform","id":"IND_NEW"},"right":{"kind":"literal","id":"-1"}}'


def test_variants(spark):
    df = specs(spark, ("a", "BTCUSDT", "1h", "TRIGGER_BAND_BREAKOUT", None, "sizing.fractional", [], None, {}), ("b", "BTCUSDT", "1h", "TRIGGER_CROSS_ABOVE", "exit.time_exit", "sizing.none", None, None, None))
    got = sorted(tuple(r) for r in B.spec_variants(df, B.component_rows(spark)).collect())
    assert got == [("a", 0, "entry.vwap_band", "exit.atr_stop", "sizing.fractional"), ("a", 1, "entry.ema_cross", "exit.time_exit", "sizing.fractional"), ("b", 0, "entry.ema_cross", "exit.time_exit", None), ("b", 1, "entry.vwap_band", "exit.atr_stop", None)]
    assert B.spec_variants(df, B.component_rows(spark).where("pillar = 'sizing'")).count() == 0


def test_findings(spark):
    components, grids = B.component_rows(spark), B.grid_rows(spark)
    fine = ("fine", "BTCUSDT", "1h", "TRIGGER_CROSS_ABOVE", "exit.time_exit", "sizing.fractional", ["IND_EMA", "close"], None, None)
    df = specs(spark, fine, ("bad", None, "2h", "TRIGGER_NONE", None, None, ["IND_NEW"], AHEAD, {"entry.fast": 60.0, "exit.bars": 500.0}))
    broken = grids.withColumn("hi", F.when(F.col("param") == "lookback", None).otherwise(F.col("hi")))
    got = {(r.spec_id, r.variant, r.rule, r.pillar, r.subject) for r in B.spec_findings(df, B.spec_variants(df, components), components, broken).collect()}
    want = {("bad", -1, "bad_data", None, None), ("bad", -1, "lookahead_bias", None, "lag(-1)"), ("bad", 0, "degenerate_window", "entry", None), ("bad", 1, "grid_bounds", "exit", "exit.time_exit.bars")}
    want |= {("bad", -1, "unbacked_primitive", None, x) for x in ("IND_NEW", "TRIGGER_NONE")} | {("bad", i, "missing_pillar", "sizing", None) for i in (0, 1)}
    assert got == want | {(s, 1, "unbounded_param", "entry", "entry.vwap_band.lookback") for s in ("fine", "bad")}
    only = specs(spark, fine)
    assert B.spec_findings(only, B.spec_variants(only, components), components, grids).count() == 0


def test_a_paper_twice_gives_its_specs_once(spark):
    row = ("p", "Long when price crosses above the EMA.", "", "btcusdt", "1h", [])
    papers = spark.createDataFrame([row, row], "paper_id string, mechanism string, hypothesis string, symbol string, granularity string, tags array<array<string>>")
    once = sorted(map(str, B.compile_specs(papers.limit(1), X.catalog_seed(spark)).collect()))
    assert sorted(map(str, B.compile_specs(papers, X.catalog_seed(spark)).collect())) == once and len(once) == 3


def test_capabilities(spark):
    assert B.capabilities(spark).where("granularity = 'unsupported'").count() == 3
    assert len(B.vocabulary()["indicators"]) == 83


def test_export(spark, tmp_path):
    papers = spark.createDataFrame([("r", "VWAP", None, "ADAUSDT", "1d", [])], "paper_id string, mechanism string, hypothesis string, symbol string, granularity string, tags array<array<string>>")
    specs = B.compile_specs(papers, X.catalog_seed(spark))
    assert B.export_specs(specs, str(tmp_path / "specs")).count() == 3
