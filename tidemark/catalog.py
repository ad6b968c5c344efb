"""The registered queries and, for each that SQL can say, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import operators as O
from .functions.columns import log_ratio
from .operators import arch, components, joins, rules, sweep, validation
from .operators import vocabulary as V
from .operators.registry import OHLCV
from .plans import ast, formulation
from .plans import reference_sql as R
from .plans.planner import Plan
from .sources import bars as B
from .sources import fixtures as X


#: How registered queries spread series over tasks: rows are dealt by a time, then blocks have so many rows.
HOURLY = {"block": "to_date(ts)", "rows": 512}
TICKS = {"block": "date_trunc('HOUR', ts)", "rows": 16_384}


def rounded(c: Column | str) -> Column:
    """To 6 digits, halves (and what is within 1e-9 below) upwards."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.501).cast("double") / 1e6


def _shown(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("symbol", "ts", *(rounded(n).alias(n) for n in names))


def _indicator(id: str) -> Callable:
    spec = O.INDICATORS[id]
    names = [f.lower() for f in spec.feeds]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(O.with_feeds(B.event_bars(spark, sf_dir), list(spec.feeds), keep=("symbol", "ts"), **HOURLY), names)

    run.__doc__ = f"{id} on hourly bars of events."
    return run


def _steps(**steps: Callable[[Plan], str]) -> Callable:
    """A query of planner steps, by column name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = Plan(**HOURLY)
        return _shown(plan.run(B.event_bars(spark, sf_dir), {n: make(plan) for n, make in steps.items()}, ("symbol", "ts")), list(steps))

    return run


def _tree(tree: dict) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(ast.evaluate(B.event_bars(spark, sf_dir), tree, **HOURLY), ["signal"])

    return run


def _component(id: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        name = id.replace(".", "_")
        return _shown(components.with_components(B.event_bars(spark, sf_dir), [id], **HOURLY), [name])

    return run


def series(id: str) -> dict:
    return {"kind": "transform", "id": id}


def number(value: float) -> dict:
    return {"kind": "literal", "id": f"{value:g}"}


def binary(op: str, left: dict, right: dict) -> dict:
    return {"kind": "binary_op", "op": op, "left": left, "right": right}


def unary(op: str, left: dict) -> dict:
    return {"kind": "unary_op", "op": op, "left": left}


C, H, L, VOL = (series(x) for x in ("close", "high", "low", "volume"))
TREES = {
    "ema": binary("ema", C, number(5)), "sma": binary("sma", C, number(7)), "zscore": binary("zscore", C, number(10)), "lag": binary("lag", C, number(3)),
    "returns": binary("returns", C, number(2)), "abs": unary("abs", binary("sub", C, series("open"))), "log": unary("log", C), "add": binary("add", H, L),
    "sub": binary("sub", H, L), "mul": binary("mul", C, VOL), "div": binary("div", C, binary("sub", H, L)), "ratio": binary("ratio", H, L),
    "planted": binary("zscore", binary("ema", C, number(3)), number(20)), "feed": binary("sub", {"kind": "indicator", "id": "IND_SMA"}, {"kind": "data_stream", "symbol": "BTCUSDT", "granularity": "1h"}),
}
_LAG = lambda x, n: f"coalesce({R.lag(x, n)}, first({x}) OVER {R.SERIES})"
_Z = lambda x, n: f"coalesce(({x} - {R.avg(x, n)}) / CASE WHEN {R.full('stddev_pop', x, n)} = 0 THEN 1 ELSE {R.full('stddev_pop', x, n)} END, 0)"
TREE_SQL = {
    "ema": ([], R.ema("close", 5)), "sma": ([], R.avg("close", 7)), "zscore": ([], _Z("close", 10)), "lag": ([], _LAG("close", 3)),
    "returns": ([{"b": _LAG("close", 2)}], "CASE WHEN b = 0 THEN -1 ELSE close / b - 1 END"), "abs": ([], "abs(close - open)"), "log": ([], "ln(greatest(close, 1e-12))"), "add": ([], "high + low"),
    "sub": ([], "high - low"), "mul": ([], "close * volume"), "div": ([], R.div("close", "high - low")), "ratio": ([], R.div("high", "low")),
    "planted": ([{"e": R.ema("close", 3)}], _Z("e", 20)), "feed": ([], f"{R.avg('close', 20)} - close"),
}

_abs_change = lambda p: p.expr(F.abs, p.change("close"), key="abs")
PRIMITIVES: dict[str, tuple[dict, list, dict]] = {
    "prim_shift": ({"shift3": lambda p: p.shift("close", 3), "lag3": lambda p: p.lag("close", 3)}, [], {"shift3": _LAG("close", 3), "lag3": R.lag("close", 3)}),
    "prim_change": ({"change": lambda p: p.change("close")}, [], {"change": "d"}),
    "prim_pct_change": ({"pct5": lambda p: p.pct_change("close", 5)}, [], {"pct5": R.pct(5)}),
    "prim_log_ratio": ({"log_ratio": lambda p: p.expr(log_ratio, "high", "low", key="logret")}, [], {"log_ratio": R._log("high", "low")}),
    "prim_rolling_sum": ({"s": lambda p: p.sum("volume", 12)}, [], {"s": R.full("sum", "volume", 12)}),
    "prim_rolling_mean": ({"m": lambda p: p.mean("close", 12)}, [], {"m": R.avg("close", 12)}),
    "prim_rolling_std": ({"s": lambda p: p.std("close", 12)}, [], {"s": R.full("stddev_pop", "close", 12)}),
    "prim_rolling_max": ({"m": lambda p: p.high("high", 12)}, [], {"m": R.full("max", "high", 12)}),
    "prim_rolling_min": ({"m": lambda p: p.low("low", 12)}, [], {"m": R.full("min", "low", 12)}),
    "prim_mean_dev": ({"d": lambda p: p.mean_dev("close", 12)}, [{"m": R.avg("close", 12)}, {"a": "abs(close - m)"}], {"d": R.avg("a", 12)}),
    "prim_wma": ({"w": lambda p: p.wma("close", 9), "w100": lambda p: p.wma("close", 100)}, [], {"w": R.wma("close", 9), "w100": R.wma("close", 100)}),
    "prim_running": ({"top": lambda p: p.running("max", "high"), "bottom": lambda p: p.running("min", "low")}, [], {"top": f"max(high) OVER {R.SO_FAR}", "bottom": f"min(low) OVER {R.SO_FAR}"}),
    "prim_true_range": ({"tr": lambda p: p.true_range()}, [], {"tr": "tr"}),
    "prim_prices": ({"hl2": lambda p: O.momentum.hl2(p), "hlc3": lambda p: O.momentum.hlc3(p)}, [], {"hl2": "hl2", "hlc3": "tp"}),
    "prim_stochastic_k": ({"k": lambda p: p.stochastic_k(9)}, [], {"k": f"100 * ({R.div('close - ' + R.full('min', 'low', 9), R.full('max', 'high', 9) + ' - ' + R.full('min', 'low', 9), '0.5')})"}),
    "prim_rma": ({"rma": lambda p: p.rma("close", 9)}, [], {"rma": R.rma("close", 9)}),
    "prim_scan_alphas": ({f"a{i}": (lambda p, a=a: p.scan("close", a)) for i, a in enumerate((1 / 14, 0.1, 0.5, 1.0))}, [], {f"a{i}": R.scan("close", repr(a)) for i, a in enumerate((1 / 14, 0.1, 0.5, 1.0))}),
}

_COMPONENT_SQL = {
    "entry.ema_cross": ([{"x": f"{R.ema('close', 10)} - {R.ema('close', 30)}"}, {"b": R.lag("x")}], "CASE WHEN x > 0 AND b <= 0 THEN 1 WHEN x < 0 AND b >= 0 THEN -1 ELSE 0 END"),
    "entry.vwap_band": ([{"v": f"sum(close * volume) OVER {R.SO_FAR} / sum(volume) OVER {R.SO_FAR}", "w": f"2 * {R.full('stddev_pop', 'close', 20)}"}], "CASE WHEN close > v + w THEN 1 WHEN close < v - w THEN -1 ELSE 0 END"),
    "exit.atr_stop": ([], f"2 * {R.rma('tr', 14)}"),
    "exit.time_exit": ([], "CASE WHEN rn >= 20 THEN 1 ELSE 0 END"),
    "sizing.atr_scaled": ([{"a": R.rma("tr", 14)}, {"b": "avg(a) OVER (PARTITION BY symbol)"}], "CASE WHEN b <= 0 THEN 0.01 ELSE least(greatest(CASE WHEN a = 0 THEN 0.5 ELSE 0.01::DOUBLE * b / a END, 0.01), 0.5) END"),
    "sizing.atr_scaled_causal": ([{"a": R.rma("tr", 14)}, {"b": f"avg(a) OVER {R.SO_FAR}"}], "CASE WHEN b <= 0 THEN 0.01 ELSE least(greatest(CASE WHEN a = 0 THEN 0.5 ELSE 0.01::DOUBLE * b / a END, 0.01), 0.5) END"),
    "sizing.fractional": ([], "0.01"),
}


def bb_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars whose close is outside the Bollinger bands: windows only."""
    out = O.with_feeds(B.event_bars(spark, sf_dir), ["IND_BB", "IND_BB_UPPER", "IND_BB_LOWER"], **HOURLY)
    signal = F.when(F.col("close") > F.col("ind_bb_upper"), 1.0).when(F.col("close") < F.col("ind_bb_lower"), -1.0).otherwise(0.0)
    return out.select("symbol", "ts", "close", rounded("ind_bb_upper").alias("upper"), rounded("ind_bb_lower").alias("lower"), signal.alias("breakout"))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.event_bars(spark, sf_dir)


def bars_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_bars(spark, sf_dir)


def all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feeds at once, over blocks of the series."""
    names = O.feed_ids()
    return _shown(O.with_feeds(B.event_bars(spark, sf_dir), names, keep=("symbol", "ts"), **HOURLY), [n.lower() for n in names])


def tick_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of all three classes on every tick as a bar of its own."""
    ticks = B.tick_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value")
    return _shown(O.with_feeds(ticks, TICK_FEEDS, keep=("symbol", "ts"), **TICKS), [f.lower() for f in TICK_FEEDS])


TICK_FEEDS = ["IND_SMA", "IND_EMA", "IND_RSI", "IND_MACD", "IND_BB_UPPER", "IND_ATR", "IND_SUPERTREND", "IND_OBV"]


def _feeds_sql(feeds: list[str], sql: dict[str, str]) -> str:
    """The feeds' own SQL side by side."""
    parts = {O.FEEDS[f][0]: sql[O.FEEDS[f][0]] for f in feeds}
    joined = " JOIN ".join(f"({q}) q{i}" + (" USING (symbol, ts)" if i else "") for i, q in enumerate(parts.values()))
    return f"SELECT symbol, ts, {', '.join(f.lower() for f in feeds)} FROM {joined}"


def _features(texts: DataFrame, id: str) -> DataFrame:
    parts = texts.withColumn("p", rules.split_entry_exit(F.col("text")))
    return parts.select(id, F.array_join(rules.detect_indicators(F.col("text")), ",").alias("feeds"), rules.detect_timeframe(F.col("text"), "1d").alias("timeframe"), rules.entry_primitive(F.col("p.entry")).alias("entry"), rules.exit_primitive(F.col("p.exit")).alias("exit"))


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixture's strategy texts say: feeds, timeframe, triggers."""
    return _features(X.texts(spark), "id")


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents say, whole texts: feeds, timeframe, triggers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _features(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")


def _bounded(phrase: str) -> str:
    """A DuckDB pattern for a whole phrase; its engine has no look-behind, so the boundary is consumed."""
    import re

    return "(^|[^a-z0-9])" + re.escape(phrase).replace("'", "''") + "s?($|[^a-z0-9])"


def _text_sql(source: str, id: str) -> str:
    firsts: dict[str, str] = {}
    for phrase, feed in O.phrase_table():
        firsts.setdefault(phrase, feed)
    phrases = X.values([(i, p, f, _bounded(p)) for i, (p, f) in enumerate(firsts.items())])
    trigger = lambda of, table, default: "CASE " + " ".join(f"WHEN regexp_matches(lower({of}), '{_bounded(p)}') THEN '{t}'" for p, t in table) + f" ELSE '{default}' END"
    marker = "(?is)^(.*?)\\b(?:" + "|".join(V.EXIT_WORDS) + ")\\b"
    units = ", ".join(f"'{k}': '{v}'" for k, v in V.UNITS.items())
    return f"""
    WITH t AS (SELECT {id} AS id, coalesce(text, '') AS text FROM {source}), p(o, phrase, feed, pattern) AS (VALUES {phrases}),
    h AS (SELECT id, o, phrase, feed FROM t JOIN p ON contains(lower(text), phrase) AND regexp_matches(lower(text), pattern)),
    k AS (SELECT id, feed, min(o) AS o FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.id = h.id AND length(g.phrase) > length(h.phrase) AND contains(g.phrase, h.phrase)) GROUP BY 1, 2),
    f AS (SELECT id, string_agg(feed, ',' ORDER BY o) AS feeds FROM k GROUP BY 1),
    s AS (SELECT id, text, regexp_matches(text, '{marker}') AS m, length(regexp_extract(text, '{marker}', 1)) AS upto,
      list_zip(regexp_extract_all(text, '{V.DURATION}', 1), regexp_extract_all(text, '{V.DURATION}', 2)) AS spans FROM t),
    e AS (SELECT *, CASE WHEN m THEN left(text, upto) ELSE text END AS entry_text, CASE WHEN m THEN substr(text, upto + 1) ELSE '' END AS exit_text,
      list_filter(spans, lambda x: MAP {{{units}}}[lower(x[2])] IS NOT NULL)[1] AS span FROM s)
    SELECT e.id AS {id}, coalesce(feeds, '') AS feeds,
      CASE WHEN span IS NULL THEN '1d' ELSE span[1]::HUGEINT::VARCHAR || MAP {{{units}}}[lower(span[2])] END AS timeframe,
      {trigger('entry_text', V.ENTRY_PHRASES, 'TRIGGER_CROSS_ABOVE')} AS entry, {trigger('exit_text', V.EXIT_PHRASES, 'TRIGGER_CROSS_BELOW')} AS exit
    FROM e LEFT JOIN f ON e.id = f.id"""


def document_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feasibility audit over all documents."""
    done = rules.audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    a = F.col("audit")
    return done.select("doc_id", "status", F.size(a["dependencies"]).cast("long").alias("n_dependencies"), F.array_join(a["models"], ",").alias("models"), F.array_join(a["hints"], ",").alias("hints"), F.size(a["mappings"]).cast("long").alias("n_mappings"))


def text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feasibility audit of the fixture's strategy texts."""
    done, a = rules.audit(X.texts(spark)), F.col("audit")
    return done.select("id", "status", F.size(a["dependencies"]).cast("long").alias("n_dependencies"), F.array_join(a["models"], ",").alias("models"), F.array_join(a["hints"], ",").alias("hints"), F.size(a["mappings"]).cast("long").alias("n_mappings"))


def _audit_sql(source: str, id: str) -> str:
    has = lambda term: f"contains(low, '{term}')"
    total = lambda terms: " + ".join(f"{has(t)}::BIGINT" for t in terms)
    any_of = lambda terms: "(" + " OR ".join(map(has, terms)) + ")"
    named = lambda terms: "coalesce(array_to_string([" + ", ".join(f"CASE WHEN {has(t)} THEN '{t}' END" for t in terms) + "], ','), '')"
    banks = [n for n, k in V.PROVIDERS.items() if k == "tradfi"]
    weak = [c for c, (_, w) in V.ANALOGS.items() if w < 0.7]
    return f"""
    WITH d AS (SELECT {id}, lower(trim(coalesce(text, ''))) AS low FROM {source})
    SELECT {id}, CASE WHEN {any_of(V.OPAQUE_MODELS)} OR ({any_of(banks)} AND NOT {any_of(V.ANALOGS)}) THEN 'REJECTED'
        WHEN {any_of(V.COMPUTE_HINTS)} OR {any_of(banks)} OR {any_of(weak)} THEN 'REQUIRES_HITL' ELSE 'PASSED' END AS status,
      {total([*V.PROVIDERS, *V.GRANULARITY_HINTS])} AS n_dependencies, {named(V.OPAQUE_MODELS)} AS models, {named(V.COMPUTE_HINTS)} AS hints, {total(V.ANALOGS)} AS n_mappings
    FROM d"""


def catalog_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.check_catalog(X.requirements(spark), X.catalog_seed(spark)).select("symbol", "required_granularity", "asset_class", "status", "proxy_source")


def _seed_values() -> str:
    return X.values([(c, s, g, deep, deep, year) for c, symbols, grains, deep, year in V.CATALOG_SEED for s in symbols for g in grains])


def _catalog_sql() -> str:
    return f"""
    WITH r(asset_class, sym, g, book, flow, since) AS (VALUES {X.values(X.REQUIREMENTS)}), c(cls, s, gran, has_book, has_flow, y) AS (VALUES {_seed_values()}),
    q AS (SELECT upper(sym) AS symbol, g, asset_class, book, flow, since FROM r),
    j AS (SELECT q.*, (SELECT min(cls) FROM c WHERE s = symbol) AS cls, (SELECT count(*) FROM c WHERE s = symbol AND gran = '1m') AS minutes, e.y, e.has_book, e.has_flow FROM q LEFT JOIN c e ON e.s = symbol AND e.gran = g),
    v AS (SELECT *, CASE WHEN cls IS NULL OR y IS NULL OR y > since THEN 'missing' WHEN book AND NOT has_book THEN CASE WHEN minutes > 0 THEN 'proxy' ELSE 'missing' END WHEN flow AND NOT has_flow THEN 'missing' ELSE 'available' END AS status FROM j)
    SELECT symbol, g AS required_granularity, coalesce(cls, asset_class) AS asset_class, status, CASE WHEN status = 'proxy' THEN 'volume_delta:1m' END AS proxy_source FROM v"""


def catalog_granularities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.granularities(X.catalog_seed(spark))


ANCHORS = [("BTCUSDT", "5m"), ("BTCUSDT", "tick"), ("ADAUSDT", "1d"), ("QQQ", "1h")]


def alternate_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.alternate_symbols(spark.createDataFrame(ANCHORS, "anchor string, timeframe string"), X.catalog_seed(spark))


def _alternate_sql() -> str:
    return f"""
    WITH a(anchor, timeframe) AS (VALUES {X.values(ANCHORS)}), c(cls, s, gran, b, f, y) AS (VALUES {_seed_values()}),
    w AS (SELECT a.*, (SELECT min(cls) FROM c WHERE s = anchor) AS own FROM a),
    m AS (SELECT s, min(cls) AS cls, list(gran) AS grains FROM c GROUP BY s),
    k AS (SELECT anchor, timeframe, m.s, row_number() OVER (PARTITION BY anchor, timeframe ORDER BY list_contains(grains, timeframe) DESC, (cls = coalesce(own, '')), m.s) AS n FROM w JOIN m ON m.s <> anchor)
    SELECT anchor, timeframe, s AS alternate FROM k WHERE n = 1"""


def math_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.maths(spark).select("id", rules.resolve_math(F.col("text")).alias("m"))
    return m.where("m is not null").select("id", "m.resolved", F.size("m.symbols").cast("long").alias("n_symbols"))


def table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validate_tables(X.cells(spark)).select("table_id", "status", "rows", "columns", F.size("errors").cast("long").alias("n_errors"))


RISKS = [("a", ["PARAMETRIC_OVERFIT_RISK"]), ("a", ["HIGH_SESSION_SENSITIVITY", "PARAMETRIC_OVERFIT_RISK"]), ("b", []), ("c", ["LOW_LIQUIDITY_FRAGILITY", "EXECUTION_SLIPPAGE_HEAVY"])]


def guard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame(RISKS, "spec string, tags array<string>").groupBy("spec").agg(F.collect_list("tags").alias("tags"))
    return tags.select("spec", F.array_join(rules.risk_union(F.col("tags")), ",").alias("risks"), rules.guard_filter(F.col("tags")).alias("guard"))


def _guard_sql() -> str:
    flat = X.values([(s, t) for s, tags in RISKS for t in tags or [None]])
    order = X.values([(i, t, V.GUARDS[t]) for i, t in enumerate(V.RISK_PRIORITY)])
    return f"""
    WITH r(spec, tag) AS (VALUES {flat}), p(o, tag, guard) AS (VALUES {order}), j AS (SELECT DISTINCT spec, r.tag, o, guard FROM r LEFT JOIN p ON r.tag = p.tag)
    SELECT spec, coalesce(string_agg(tag, ',' ORDER BY o), '') AS risks, arg_min(guard, o) AS guard FROM j GROUP BY spec"""


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks under their headings."""
    return rules.chunk_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.grid(spark, components.CURATED[0])


def ema_cross_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sweep.ema_cross_sweep(B.event_bars(spark, sf_dir), [5, 10, 20], [20, 30, 60], **HOURLY)
    return out.withColumn("mean_return", rounded("mean_return"))


def _sweep_sql() -> str:
    pairs = [(f, s) for f in (5, 10, 20) for s in (20, 30, 60) if f < s]
    spans = sorted({n for p in pairs for n in p})
    one = lambda f, s: f"SELECT symbol, ts, {f} AS fast, {s} AS slow, close, e{f} - e{s} AS x FROM x0"
    base = R.query([{f"e{n}": R.ema("close", n) for n in spans}], {"x": "0"}).split(" SELECT symbol, ts, floor")[0]
    return f"""{base}, u AS ({' UNION ALL '.join(one(f, s) for f, s in pairs)}),
    g AS (SELECT *, lag(x) OVER o AS b, lead(close) OVER o AS nxt FROM u WINDOW o AS (PARTITION BY symbol, fast, slow ORDER BY ts)),
    s AS (SELECT *, CASE WHEN x > 0 AND b <= 0 THEN 1 WHEN x < 0 AND b >= 0 THEN -1 END AS e FROM g),
    h AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol, fast, slow ORDER BY ts), 0) * (nxt - close) / CASE WHEN close = 0 THEN 1 ELSE close END AS r FROM s)
    SELECT symbol, fast::INT AS fast, slow::INT AS slow, count(*) AS bars, count(*) FILTER (e = 1) AS ups, count(*) FILTER (e = -1) AS downs, {R.rounded('avg(r)')} AS mean_return FROM h GROUP BY 1, 2, 3"""


def garch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arch.fit_arch(B.event_bars(spark, sf_dir), "garch", burn_in=100)


FITS = [("garch", 1e-5, 0.08, 0.90, None, 2e-4, -0.02), ("gjr", 1e-5, 0.05, 0.85, 0.12, 2e-4, -0.02), ("egarch", -0.45, 0.12, -0.85, 0.15, 2e-4, -0.02)]


def garch_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = spark.createDataFrame([(m, o, a, b, g, v, r, 252.0) for m, o, a, b, g, v, r in FITS], "model string, omega double, alpha double, beta double, gamma double, last_variance double, last_return double, annualise double")
    return arch.forecast_arch(fits, 10).withColumn("volatility", rounded("volatility"))


def _forecast_sql() -> str:
    return f"""
    WITH f(model, o, a, b, g, v, r) AS (VALUES {X.values(FITS)}), n AS (SELECT model, o::DOUBLE o, a::DOUBLE a, b::DOUBLE b, coalesce(g, 0)::DOUBLE g, v::DOUBLE v, r::DOUBLE r, unnest(range(0, 11))::INT AS step FROM f),
    k AS (SELECT *, CASE WHEN model = 'gjr' THEN g ELSE 0 END AS j FROM n),
    c AS (SELECT *, o + (a + CASE WHEN r < 0 THEN j ELSE 0 END) * r * r + b * v AS one, a + b + j / 2 AS decay, o / (1 - b) AS mu, o + b * ln(v) + a * r / sqrt(v) + g * (abs(r / sqrt(v)) - sqrt(2 / pi())) AS lone FROM k)
    SELECT model, step, {R.rounded("sqrt(252 * CASE WHEN step = 0 THEN v WHEN model = 'egarch' THEN exp(mu + pow(b, step) * (lone - mu)) ELSE o / (1 - decay) + pow(decay, step - 1) * (one - o / (1 - decay)) END)")} AS volatility FROM c"""


def deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indicators that are left out, and why."""
    return spark.createDataFrame(list(V.DEFERRED.items()), "id string, reason string")


def phrase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrase table, in its order."""
    return spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(O.phrase_table())], "ord int, phrase string, feed string")


PAPERS = [
    ("p1", "Long when price crosses above the EMA on 15 minute bars; exit when it falls below.", "Trends persist.", "btcusdt", "1h", [["HIGH_SESSION_SENSITIVITY"], ["PARAMETRIC_OVERFIT_RISK"]]),
    ("p2", "Band breakout of Bollinger Bands.", "", "ADAUSDT", "1d", []), ("p2", "Band breakout of Bollinger Bands.", "", "ADAUSDT", "1d", []), ("p3", "VWAP reversion.", "", "QQQ", "1h", []),
]


def spec_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications compiled from three papers; the third one's anchor is not in the catalog."""
    papers = spark.createDataFrame(PAPERS, "paper_id string, mechanism string, hypothesis string, symbol string, granularity string, tags array<array<string>>")
    out = formulation.compile_specs(papers, X.catalog_seed(spark))
    return out.select("paper_id", "tier", "target_asset", "timeframe", "entry_trigger_primitive", "exit_trigger_primitive", F.array_join("filter_primitives", ",").alias("filters"), F.array_join("indicators", ",").alias("indicators"), "mode", "origin", "secondary_signal")


_SPEC_ROWS = [
    ("p1", t, a, "15m", "TRIGGER_CROSS_ABOVE", "TRIGGER_CROSS_BELOW", f, "IND_EMA", m, o, x)
    for t, a, f, m, o, x in (
        ("TIER_0_LITERAL", "BTCUSDT", "", "static", "paper_literal", None), ("TIER_1_PARAMETRIC", "BTCUSDT", "FLT_TIME_OF_DAY", "static", "paper_literal_with_guard", None),
        ("TIER_2_GENERALIZED", "ADAUSDT", "FLT_TIME_OF_DAY", "dynamic", "generalized_from:BTCUSDT", None), ("TIER_3_AUGMENTED", "BTCUSDT", "FLT_TIME_OF_DAY", "dynamic", "augmented_with_secondary_signal", "IND_AD"),
    )
] + [
    ("p2", t, a, "1d", "TRIGGER_BAND_BREAKOUT", "TRIGGER_CROSS_BELOW", "", "IND_BB", m, o, x)
    for t, a, m, o, x in (("TIER_0_LITERAL", "ADAUSDT", "static", "paper_literal", None), ("TIER_2_GENERALIZED", "BTCUSDT", "dynamic", "generalized_from:ADAUSDT", None), ("TIER_3_AUGMENTED", "ADAUSDT", "dynamic", "augmented_with_secondary_signal", "IND_AD"))
]


#: Specifications for the rules on variants: spec_id, asset, timeframe, triggers, sizing, primitives, tree, values.
SPECS = [
    ("s1", "BTCUSDT", "1h", "TRIGGER_CROSS_ABOVE", "exit.time_exit", "sizing.fractional", ["IND_EMA", "close"], None, None), ("s2", "ADAUSDT", "2h", "TRIGGER_BAND_BREAKOUT", "exit.stop_loss", "sizing.none", ["IND_NEW"], None, {"entry.fast": 80.0, "entry.slow": 40.0}),
    ("s3", None, "1d", "TRIGGER_CROSS_BELOW", None, "sizing.atr_scaled", [], '{"kind":"binary_op","op":"lag","left":{"kind":"transform","id":"close"},"right":{"kind":"literal","id":"-2"}}', {"exit.bars": 900.0}), ("s4", "ETHUSDT", "15m", None, None, None, None, None, {"sizing.fraction": 2.0}),
]


def spec_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of four specifications."""
    return formulation.spec_variants(spark.createDataFrame(SPECS, formulation.SPEC_FIELDS), formulation.component_rows(spark))


def spec_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules four specifications and their variants break."""
    specs, parts = spark.createDataFrame(SPECS, formulation.SPEC_FIELDS), formulation.component_rows(spark)
    return formulation.spec_findings(specs, formulation.spec_variants(specs, parts), parts, formulation.grid_rows(spark))


def _variants_cte() -> str:
    parts = [(c.id, c.pillar, p) for c in components.CURATED for p in c.implements]
    return f"""sp(spec_id, asset, tf, ent, ext, sz) AS (VALUES {X.values([r[:6] for r in SPECS])}), im(cid, pillar, prim) AS (VALUES {X.values(parts)}), co AS (SELECT DISTINCT cid, pillar FROM im),
    o AS (SELECT spec_id, pillar, cid, row_number() OVER (PARTITION BY spec_id, pillar ORDER BY NOT EXISTS (SELECT 1 FROM im WHERE im.cid = co.cid AND prim = CASE pillar WHEN 'entry' THEN ent ELSE ext END), cid) - 1 AS i FROM sp, co WHERE pillar <> 'sizing'),
    vn AS (SELECT DISTINCT spec_id, i::INT AS variant FROM o WHERE i < 4),
    pk AS (SELECT vn.spec_id, variant, p.pillar, coalesce((SELECT cid FROM o WHERE o.spec_id = vn.spec_id AND o.pillar = p.pillar AND i = variant), (SELECT cid FROM o WHERE o.spec_id = vn.spec_id AND o.pillar = p.pillar AND i = 0)) AS cid FROM vn, (VALUES ('entry'), ('exit')) p(pillar)),
    va AS (SELECT spec_id, variant, max(cid) FILTER (pillar = 'entry') AS entry, max(cid) FILTER (pillar = 'exit') AS exit, (SELECT cid FROM co, sp WHERE sp.spec_id = pk.spec_id AND cid = sz AND co.pillar = 'sizing') AS sizing FROM pk GROUP BY spec_id, variant)"""


def _findings_sql() -> str:
    grid = X.values([(c.id, n, g["default"], g["lo"], g["hi"], g["step"]) for c in components.CURATED for n, g in sweep.pillar_grid(c).items()])
    named = X.values([(r[0], x) for r in SPECS for x in {*(r[6] or []), r[3], r[4]} if x])
    known = X.values([(x,) for x in sorted({*O.FEEDS, *OHLCV, "literal", *(p for c in components.CURATED for p in c.implements)})])
    given = X.values([(r[0], k, v) for r in SPECS for k, v in (r[8] or {}).items()])
    trees = X.values([(r[0], r[7]) for r in SPECS])
    return f"""
    WITH {_variants_cte()}, gr(cid, param, dflt, lo, hi, step) AS (VALUES {grid}), gv(spec_id, name, val) AS (VALUES {given}), nm(spec_id, prim) AS (VALUES {named}), kn(prim) AS (VALUES {known}), tr(spec_id, tree) AS (VALUES {trees}),
    pl AS (SELECT spec_id, variant, 'entry' AS pillar, entry AS cid FROM va UNION ALL SELECT spec_id, variant, 'exit', exit FROM va UNION ALL SELECT spec_id, variant, 'sizing', sizing FROM va),
    vl AS (SELECT pl.*, param, lo, hi, step, coalesce((SELECT val FROM gv WHERE gv.spec_id = pl.spec_id AND name = pillar || '.' || param), dflt) AS v FROM pl JOIN gr USING (cid))
    SELECT spec_id, -1 AS variant, 'bad_data' AS rule, 'critical' AS severity, NULL AS pillar, NULL AS subject FROM sp WHERE asset IS NULL OR tf NOT IN ({', '.join(f"'{g}'" for g in ast.GRANULARITIES)})
    UNION ALL SELECT spec_id, -1, 'unbacked_primitive', 'critical', NULL, prim FROM nm WHERE prim NOT IN (SELECT prim FROM kn)
    UNION ALL SELECT spec_id, -1, 'lookahead_bias', 'critical', NULL, (tree->>'op') || '(' || (tree->'right'->>'id') || ')' FROM tr WHERE tree->>'op' IN ('lag', 'returns') AND (tree->'right'->>'id')::DOUBLE < 0
    UNION ALL SELECT spec_id, variant, 'missing_pillar', 'high', pillar, cid FROM pl WHERE cid IS NULL
    UNION ALL SELECT spec_id, variant, 'unbounded_param', 'medium', pillar, cid || '.' || param FROM vl WHERE lo IS NULL OR hi IS NULL
    UNION ALL SELECT spec_id, variant, 'grid_bounds', 'high', pillar, cid || '.' || param FROM vl WHERE lo >= hi OR step <= 0 OR v < lo OR v > hi
    UNION ALL SELECT f.spec_id, f.variant, 'degenerate_window', 'high', 'entry', NULL FROM vl f JOIN vl s USING (spec_id, variant, cid) WHERE cid = 'entry.ema_cross' AND f.param = 'fast' AND s.param = 'slow' AND s.v <= f.v"""


def all_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the catalog has what each symbol's requirements ask for, and all of them."""
    verdicts = rules.check_catalog(X.requirements(spark), X.catalog_seed(spark))
    return verdicts.groupBy("symbol").agg(F.bool_and(F.col("status") != "missing").alias("all_available")).unionByName(rules.all_available(verdicts).select(F.lit("all").alias("symbol"), "all_available"))


def conversation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1 200 characters of each conversation's turns, in order."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.row_number().over(order).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    return rules.join_chunks(turns, 1200, "conv_id", "turn", "text")


_DIGEST_SQL = """
    WITH t AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM conversations)
    SELECT conv_id, left(string_agg(text, '' ORDER BY n), 1200) AS text FROM t GROUP BY conv_id"""


def sweep_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How flat the surface of the crossing's mean returns is, by symbol."""
    out = sweep.surface_decay(ema_cross_sweep(spark, sf_dir), "mean_return", ["symbol"])
    return out.select("symbol", F.round("surface_decay", 3).alias("surface_decay"))


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulation.capabilities(spark).select("name", "type", "granularity", F.array_join("primitives", ",").alias("primitives"))


def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part on each of ten paths over the hourly bars."""
    out = validation.purged_folds(B.event_bars(spark, sf_dir), purge_days=1, embargo_days=0.5, block=HOURLY["block"])
    return out.groupBy("symbol", "path", "part").agg(F.count("*").alias("n"))


_FOLDS_SQL = f"""WITH {R.BARS.split(', l0 AS')[0]}, f AS (SELECT symbol, epoch(ts) AS t, ntile(5) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars),
    e AS (SELECT symbol, k, min(t) AS lo, max(t) AS hi FROM f GROUP BY 1, 2), c AS (SELECT a, b, (row_number() OVER (ORDER BY a, b) - 1)::INT AS path FROM range(1, 6) x(a), range(1, 6) y(b) WHERE a < b),
    j AS (SELECT f.symbol, path, k IN (a, b) AS test, (SELECT bool_or((t < lo AND t > lo - 86400) OR (t > hi AND t < hi + 43200)) FROM e WHERE e.symbol = f.symbol AND e.k IN (a, b)) AS near FROM f, c)
    SELECT symbol, path, CASE WHEN test THEN 'test' WHEN near THEN 'dropped' ELSE 'train' END AS part, count(*) AS n FROM j GROUP BY 1, 2, 3"""


def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validation.bands(B.event_bars(spark, sf_dir), ["symbol"], "close")
    return out.select("symbol", *(rounded(p).alias(p) for p in ("p10", "p50", "p90")))


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.block_bootstrap(B.event_bars(spark, sf_dir), "close", samples=200)


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.thin(B.event_bars(spark, sf_dir), "close", 100)


def bars_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly and daily bars, a bar per series, and one of everything, from one read of events."""
    return B.bar_sets(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id")


_ROLLUP_SQL = """
    SELECT event_type AS symbol, CASE WHEN h IS NOT NULL THEN '1h' WHEN d IS NOT NULL THEN '1d' END AS granularity, coalesce(h, d) AS ts,
      arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
    FROM (SELECT *, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d FROM events WHERE value IS NOT NULL AND ts IS NOT NULL) e
    GROUP BY GROUPING SETS ((event_type, h), (event_type, d), (event_type), ())"""


def asof_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of the same user that is not later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return joins.asof_join(bought, views, ["user_id"], "ts", "view_ts", ["view_id", "view_ts", "view_value"], 7 * 86_400, tie="view_id")


_ASOF_VIEWS_SQL = """
    WITH v AS (SELECT user_id, ts AS view_ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
    SELECT p.event_id, p.user_id, p.ts, p.value, view_id, view_ts, view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.view_ts"""


def asof_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the last daily bar of its priority before its day, if it is at most three days old."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_orderdate")
    bars = B.order_bars(spark, sf_dir).select(F.col("symbol").alias("o_orderpriority"), F.col("ts").alias("bar_ts"), "close", "volume")
    return joins.asof_join(orders, bars, ["o_orderpriority"], "o_orderdate", "bar_ts", ["bar_ts", "close", "volume"], 30 * 86_400, strict=True, within=3 * 86_400)


_ASOF_BARS_SQL = """
    WITH b AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS bar_ts, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2),
    j AS (SELECT o_orderkey, o_orderpriority, o_orderdate, bar_ts, close, volume, epoch(o_orderdate) - epoch(bar_ts) <= 259200 AS fresh FROM orders o ASOF LEFT JOIN b ON o.o_orderpriority = b.symbol AND o.o_orderdate > b.bar_ts)
    SELECT o_orderkey, o_orderpriority, o_orderdate, CASE WHEN fresh THEN bar_ts END AS bar_ts, CASE WHEN fresh THEN close END AS close, CASE WHEN fresh THEN volume END AS volume FROM j"""


def fold_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leakage of folds that are purged by six hours while labels look twelve ahead, beside that of folds purged enough."""
    short, enough = (validation.leaks(validation.purged_folds(B.event_bars(spark, sf_dir), purge_days=days, embargo_days=days, block=HOURLY["block"]), 12 * 3600) for days in (0.25, 1))
    return short.withColumn("purge", F.lit("6 hours")).unionByName(enough.withColumn("purge", F.lit("1 day")))


def _leaks_sql() -> str:
    one = lambda days: f"""SELECT symbol, path, count(*) AS n_train, count(*) FILTER (leak) AS n_leaks, bool_or(leak) AS leakage_detected, '{'6 hours' if days < 1 else '1 day'}' AS purge FROM (
      SELECT a.symbol, a.path, a.t, bool_or(coalesce(b.t <= a.t + 43200 AND b.t + 43200 >= a.t, false)) AS leak
      FROM (SELECT * FROM p WHERE days = {days} AND part = 'train') a LEFT JOIN (SELECT * FROM p WHERE days = {days} AND part = 'test') b ON a.symbol = b.symbol AND a.path = b.path AND b.t <= a.t + 43200 AND b.t + 43200 >= a.t
      GROUP BY a.symbol, a.path, a.t) x GROUP BY symbol, path"""  # noqa: E731
    return f"""WITH {R.HOURS}, f AS (SELECT symbol, epoch(ts) AS t, ntile(5) OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars),
    e AS (SELECT symbol, k, min(t) AS lo, max(t) AS hi FROM f GROUP BY 1, 2), c AS (SELECT a, b, (row_number() OVER (ORDER BY a, b) - 1)::INT AS path FROM range(1, 6) x(a), range(1, 6) y(b) WHERE a < b), ds(days) AS (VALUES (0.25), (1)),
    j AS (SELECT days, f.symbol, t, path, k IN (a, b) AS test, (SELECT bool_or((t < lo AND t > lo - 86400 * days) OR (t > hi AND t < hi + 86400 * days)) FROM e WHERE e.symbol = f.symbol AND e.k IN (a, b)) AS near FROM f, c, ds),
    p AS (SELECT days, symbol, t, path, CASE WHEN test THEN 'test' WHEN near THEN 'dropped' ELSE 'train' END AS part FROM j)
    {one(0.25)} UNION ALL {one(1)}"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events that follow within a day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = joins.sessions(events, ["user_id"], "ts", "24 hours", F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


_SESSIONS_SQL = """
    WITH g AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 86400, true) AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS "rows", count(*) FILTER (event_type = 'purchase') AS purchases FROM s GROUP BY user_id, n"""


def tick_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all ticks from sketches, by whether the rank of each is within 0.01 of what was asked for."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "value")
    bands = validation.sketched_bands(ticks, ["symbol"], "value")
    # A row per series.
    near = lambda p, c: ((F.count_if(F.col("value") < F.col(c)) / F.first("n") <= p + 0.01) & (F.count_if(F.col("value") <= F.col(c)) / F.first("n") >= p - 0.01)).alias(f"{c}_near")
    return ticks.join(bands, "symbol").groupBy("symbol").agg(F.first("n").alias("n"), near(0.1, "p10"), near(0.5, "p50"), near(0.9, "p90"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines as a table of parameters, checked: quantities have to be numbers, (discount, tax) a range."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.withColumn("row", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))  # numbers repeat within an order
    hundredth = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    bounds = F.concat(F.lit("["), hundredth("l_discount"), F.lit(", "), hundredth("l_tax"), F.when(F.col("l_linestatus") == "F", "]").otherwise(" ]"))
    cell = lambda row, i, c: F.struct(row.alias("row"), F.lit(i).alias("col"), c.alias("text"))
    body = [cell(F.col("row"), 0, F.col("l_returnflag")), cell(F.col("row"), 1, F.col("l_quantity").cast("int").cast("string")), cell(F.col("row"), 2, bounds)]
    head = [cell(F.lit(0), i, F.when((F.col("l_orderkey") % 7 == 0) & (i == 1), "Qty").otherwise(n)) for i, n in enumerate(("Param", "Value", "Bounds"))]
    # The header comes with the first line, so lines are read and dealt to tasks once.
    cells = lines.select(F.col("l_orderkey").alias("table_id"), F.inline(F.when(F.col("row") == 1, F.array(*head, *body)).otherwise(F.array(*body))))
    report = rules.validate_tables(cells)
    return report.select("table_id", "status", "rows", F.col("columns").cast("int").alias("columns"), F.size("errors").cast("long").alias("n_errors"))


_ORDER_TABLES_SQL = """
    SELECT l_orderkey AS table_id, CASE WHEN l_orderkey % 7 = 0 THEN 'orphan' WHEN count(*) FILTER (round(l_discount * 100) > round(l_tax * 100)) > 0 THEN 'parse-error' ELSE 'fit' END AS status, count(*) AS rows, 3 AS columns,
      CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE least(count(*) FILTER (round(l_discount * 100) > round(l_tax * 100)), 20) END AS n_errors
    FROM lineitem GROUP BY l_orderkey"""


def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether bars made of the tables serve what documents ask for: a series for each, the timeframe that its text names."""
    at = lambda name, symbol, ts, kind: spark.read.parquet(f"{sf_dir}/{name}.parquet").groupBy(F.upper(symbol).alias("symbol")).agg(F.year(F.min(ts)).alias("start_year")).select(F.lit(kind).alias("asset_class"), "symbol", F.explode(F.array(*map(F.lit, {"Event": ("1m", "1h", "1d"), "Order": ("1d",)}[kind]))).alias("granularity"), F.lit(False).alias("has_l2_book"), F.lit(kind == "Event").alias("has_order_flow"), "start_year")
    catalog = at("events", "event_type", "ts", "Event").unionByName(at("orders", "o_orderpriority", "o_orderdate", "Order"))
    series = F.array(*map(F.lit, ("view", "click", "1-urgent", "5-low", "nothing")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asks = docs.select("doc_id", F.lit("Text").alias("asset_class"), F.get(series, (F.col("doc_id") % 5).cast("int")).alias("symbol"), rules.detect_timeframe(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "1d").otherwise("1h")).alias("required_granularity"), (F.col("doc_id") % 3 == 0).alias("requires_l2_book"), (F.col("doc_id") % 4 == 0).alias("requires_order_flow"), F.when(F.col("doc_id") % 6 == 0, 2000).alias("start_year"))
    return rules.check_catalog(asks, catalog).select("doc_id", "symbol", "required_granularity", "asset_class", "status", "proxy_source")


def _event_catalog_sql() -> str:
    units = ", ".join(f"'{k}': '{v}'" for k, v in V.UNITS.items())
    return f"""
    WITH c AS (SELECT 'Event' AS kind, upper(event_type) AS s, unnest(['1m', '1h', '1d']) AS g, true AS flow, year(min(ts)) AS y FROM events GROUP BY 2
      UNION ALL SELECT 'Order', upper(o_orderpriority), '1d', false, year(min(o_orderdate)) FROM orders GROUP BY 2),
    d AS (SELECT doc_id, upper(['view', 'click', '1-urgent', '5-low', 'nothing'][doc_id % 5 + 1]) AS symbol, list_filter(list_zip(regexp_extract_all(coalesce(text, ''), '{V.DURATION}', 1), regexp_extract_all(coalesce(text, ''), '{V.DURATION}', 2)), lambda x: MAP {{{units}}}[lower(x[2])] IS NOT NULL)[1] AS span FROM documents),
    q AS (SELECT doc_id, symbol, CASE WHEN span IS NOT NULL THEN span[1]::HUGEINT::VARCHAR || MAP {{{units}}}[lower(span[2])] WHEN doc_id % 2 = 0 THEN '1d' ELSE '1h' END AS g FROM d),
    j AS (SELECT q.*, (SELECT min(kind) FROM c WHERE s = symbol) AS kind, (SELECT count(*) FROM c WHERE s = symbol AND c.g = '1m') AS minutes, e.y, e.flow FROM q LEFT JOIN c e ON e.s = symbol AND e.g = q.g),
    v AS (SELECT *, CASE WHEN kind IS NULL OR y IS NULL OR (doc_id % 6 = 0 AND y > 2000) THEN 'missing' WHEN doc_id % 3 = 0 THEN CASE WHEN minutes > 0 THEN 'proxy' ELSE 'missing' END WHEN doc_id % 4 = 0 AND NOT flow THEN 'missing' ELSE 'available' END AS status FROM j)
    SELECT doc_id, symbol, g AS required_granularity, coalesce(kind, 'Text') AS asset_class, status, CASE WHEN status = 'proxy' THEN 'volume_delta:1m' END AS proxy_source FROM v"""


#: Words of the documents that stand for symbols here.
SYMBOL_WORDS = ((" the ", " σ "), (" and ", " ± "), (" of ", r" $\beta + x$ "), (" la ", " ≤ "))


def document_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with some common words written as symbols, and the symbols resolved: how long the text is, and its digest.

    Overlapping pieces are replaced from the last to the first, as the SQL has them (see README).
    """
    text = F.coalesce("text", F.lit(""))
    for word, symbol in SYMBOL_WORDS:
        text = F.replace(text, F.lit(word), F.lit(symbol))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", rules.resolve_math(text, last_first=True).alias("m")).where("m is not null")
    return docs.select("doc_id", F.length("m.resolved").cast("long").alias("n_chars"), F.sha2("m.resolved", 256).alias("sha256"), F.array_join(F.sort_array("m.symbols"), ",").alias("symbols"))


def _document_symbols_sql() -> str:
    text = "coalesce(text, '')"
    for word, symbol in SYMBOL_WORDS:
        text = f"replace({text}, '{word}', '{symbol}')"
    # Inline pieces: what the first symbol in each stands for; then the symbols that are left, in the table's order.
    first = "CASE " + " ".join(f"WHEN contains(p, '{s}') THEN '{d}'" for s, d in V.SYMBOLS.items()) + " END"
    name = "CASE " + " ".join(f"WHEN contains(p, '{s}') THEN '{s}'" for s in V.SYMBOLS) + " ELSE p END"
    left = "u"
    for s, d in V.SYMBOLS.items():
        left = f"replace({left}, '{s}', '{d}')"
    rest = ", ".join(f"CASE WHEN contains(u, '{s}') THEN '{s}' END" for s in V.SYMBOLS)
    pattern = V.INLINE_LATEX.replace("'", "''")
    return f"""
    WITH t AS (SELECT doc_id, {text} AS t FROM documents), p AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ps FROM t),
    u AS (SELECT doc_id, list_reduce(list_prepend(t, list_distinct(list_filter(ps, lambda p: {first} IS NOT NULL))), lambda a, p: replace(a, p, {first})) AS u, list_transform(ps, lambda p: {name}) AS used FROM p),
    r AS (SELECT doc_id, trim({left}) AS r, list_sort(list_distinct(list_concat(used, list_filter([{rest}], lambda x: x IS NOT NULL)))) AS symbols FROM u)
    SELECT doc_id, length(r) AS n_chars, sha256(r) AS sha256, array_to_string(symbols, ',') AS symbols FROM r WHERE len(symbols) > 0"""


_PLAIN = (tick_bands, order_tables, event_catalog, document_symbols, bars_rollup, asof_views, asof_bars, fold_leaks, user_sessions, spec_variants, spec_findings, all_available, conversation_digest, sweep_decay, spec_matrix, capabilities, purged_folds, price_bands, bootstrap_means, thinned, bb_breakout, bars_hourly, bars_daily_orders, all_feeds, tick_feeds, text_features, document_features, document_audit, text_audit, catalog_check, catalog_granularities, alternate_symbol, math_symbols, table_report, guard_filters, page_chunks, sweep_grid, ema_cross_sweep, garch_fit, garch_forecast, deferred, phrase_rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in _PLAIN}
    out |= {id.lower(): _indicator(id) for id in O.INDICATORS}
    out |= {name: _steps(**steps) for name, (steps, _, _) in PRIMITIVES.items()}
    out |= {f"ast_{name}": _tree(tree) for name, tree in TREES.items()}
    return out | {id.replace(".", "_"): _component(id) for id in components.BUILDERS}


def oracle_sql() -> dict[str, str]:
    out = {
        "bb_breakout": R.query([{"m": R.avg("close", 20), "s": R.full("stddev_pop", "close", 20)}], {"upper": "m + 2 * s", "lower": "m - 2 * s"}).replace("SELECT symbol, ts, floor", "SELECT symbol, ts, close, CASE WHEN close > m + 2 * s THEN 1.0::DOUBLE WHEN close < m - 2 * s THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS breakout, floor"),
        "all_feeds": _feeds_sql(O.feed_ids(), R.indicator_sql()), "tick_feeds": _feeds_sql(TICK_FEEDS, R.indicator_sql(R.TICKS)),
        "tick_bands": "SELECT event_type AS symbol, count(value) AS n, true AS p10_near, true AS p50_near, true AS p90_near FROM events GROUP BY 1", "order_tables": _ORDER_TABLES_SQL, "event_catalog": _event_catalog_sql(), "document_symbols": _document_symbols_sql(),
        "bars_rollup": _ROLLUP_SQL, "asof_views": _ASOF_VIEWS_SQL, "asof_bars": _ASOF_BARS_SQL, "fold_leaks": _leaks_sql(), "user_sessions": _SESSIONS_SQL,
        "bars_hourly": "WITH " + R.BARS.split(", l0 AS")[0] + " SELECT * FROM bars",
        "bars_daily_orders": "SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume FROM orders WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2",
        "text_features": _text_sql(f"(VALUES {X.values(X.TEXTS)}) x(id, text)", "id"), "document_features": _text_sql("documents", "doc_id"), "document_audit": _audit_sql("documents", "doc_id"), "text_audit": _audit_sql(f"(VALUES {X.values(X.TEXTS)}) x(id, text)", "id"),
        "spec_variants": f"WITH {_variants_cte()} SELECT * FROM va", "spec_findings": _findings_sql(), "conversation_digest": _DIGEST_SQL,
        "all_available": f"WITH a AS ({_catalog_sql()}) SELECT symbol, bool_and(status <> 'missing') AS all_available FROM a GROUP BY 1 UNION ALL SELECT 'all', bool_and(status <> 'missing') FROM a",
        "sweep_decay": f"SELECT symbol, round(1 - stddev_pop(mean_return) / abs(avg(mean_return)), 3) AS surface_decay FROM ({_sweep_sql()}) x GROUP BY 1",
        "phrase_rows": f"WITH p(phrase, feed) AS (VALUES {X.values(sorted((p, f) for p, f in O.phrase_table()))}) SELECT (row_number() OVER (ORDER BY length(phrase) DESC, phrase, feed) - 1)::INT AS ord, phrase, feed FROM p",
        "catalog_check": _catalog_sql(), "catalog_granularities": f"SELECT DISTINCT gran AS granularity FROM (VALUES {_seed_values()}) c(cls, s, gran, b, f, y)", "alternate_symbol": _alternate_sql(),
        "spec_matrix": f"SELECT * FROM (VALUES {X.values(_SPEC_ROWS)}) s(paper_id, tier, target_asset, timeframe, entry_trigger_primitive, exit_trigger_primitive, filters, indicators, mode, origin, secondary_signal)",
        "capabilities": f"SELECT * FROM (VALUES {X.values([(n, k, g, ','.join(p)) for n, k, g, p in formulation.CAPABILITIES])}) c(name, type, granularity, primitives)",
        "purged_folds": _FOLDS_SQL, "price_bands": f"WITH {R.BARS.split(', l0 AS')[0]} SELECT symbol, {', '.join(f'{R.rounded(f'quantile_cont(close, {p})')} AS p{round(100 * p)}' for p in (0.1, 0.5, 0.9))} FROM bars GROUP BY 1",
        "guard_filters": _guard_sql(), "ema_cross_sweep": _sweep_sql(), "garch_forecast": _forecast_sql(),
        "sweep_grid": "SELECT (f * 6 + s)::BIGINT AS param_id, round(1 + f * 19.8, 6)::DOUBLE AS fast, round(2 + s * 59.6, 6)::DOUBLE AS slow FROM range(6) a(f), range(6) b(s)",
        "deferred": f"SELECT * FROM (VALUES {X.values(list(V.DEFERRED.items()))}) d(id, reason)",
        "math_symbols": f"""SELECT * FROM (VALUES {X.values([(1, "Let sigma (annualized volatility) less than or equal to 2 and alpha (excess return) plus or minus 1.", 4), (2, "Use sigma (annualized volatility) and " + chr(92) + "(y" + chr(92) + ") with beta (market sensitivity).", 3), (4, "$z$ only", 1), (5, "summation multiplied by delta (sensitivity / change)", 3)])}) m(id, resolved, n_symbols)""",
        "table_report": "SELECT * FROM (VALUES ('fit', 'fit', 2, 3, 0), ('bad', 'parse-error', 4, 3, 5), ('orphan', 'orphan', 1, 2, 1)) t(table_id, status, rows, columns, n_errors)",
    }
    out |= {id.lower(): sql for id, sql in R.indicator_sql().items()}
    out |= {name: R.query(layers, columns) for name, (_, layers, columns) in PRIMITIVES.items()}
    out |= {f"ast_{name}": R.query(layers, {"signal": value}) for name, (layers, value) in TREE_SQL.items()}
    return out | {id.replace(".", "_"): R.query(layers, {id.replace(".", "_"): value}) for id, (layers, value) in _COMPONENT_SQL.items()}
