"""From papers to specifications to variants, and the rules that both are held to.

All of it is DataFrame transforms over any number of papers and specifications; the components and their grids are a
small dimension that is read from the manifest.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.components import load_manifest
from ..operators.registry import FEEDS, OHLCV, feed_ids
from ..operators.sweep import pillar_grid
from .ast import GRANULARITIES, look_ahead, primitive_ids

PILLARS = ("entry", "exit", "sizing")
MOST_VARIANTS, MOST_SPECS = 4, 5
TIERS = ("TIER_0_LITERAL", "TIER_1_PARAMETRIC", "TIER_2_GENERALIZED", "TIER_3_AUGMENTED")


def compile_specs(papers: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per specification of each paper whose anchor the catalog has.

    papers: paper_id, mechanism, hypothesis, symbol, granularity, tags (array of arrays of risk tags).  Tiers: the
    paper's own rule; with the guard of its first risk; carried over to another symbol; with one more signal.  Of a
    paper's specifications with the same asset, timeframe and tier (a paper that is there twice) the first one stays.
    """
    anchored = papers.withColumn("anchor", F.upper("symbol")).join(catalog.select(F.col("symbol").alias("anchor")).distinct(), "anchor", "left_semi")
    text = F.concat_ws(" ", "mechanism", "hypothesis")
    read = anchored.withColumn("clauses", rules.split_entry_exit(text)).select(
        "paper_id", "anchor", rules.detect_timeframe(F.col("mechanism"), F.col("granularity")).alias("timeframe"), rules.entry_primitive(F.col("clauses.entry")).alias("entry_trigger_primitive"),
        rules.exit_primitive(F.col("clauses.exit")).alias("exit_trigger_primitive"), rules.detect_indicators(text).alias("indicators"), rules.risk_union(F.col("tags")).alias("risk_annotations"), rules.guard_filter(F.col("tags")).alias("guard"))
    asked = read.select("anchor", "timeframe").distinct()
    known = read.join(rules.alternate_symbols(asked, catalog), ["anchor", "timeframe"], "left").withColumn("secondary", rules.secondary_signal(F.col("indicators")))
    guards = F.when(F.col("guard").isNotNull(), F.array("guard")).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")

    def spec(tier: int, asset: Column, filters: Column, mode: str, origin: Column, secondary: Column) -> Column:
        return F.struct(F.lit(TIERS[tier]).alias("tier"), asset.alias("target_asset"), filters.alias("filter_primitives"), F.lit(mode).alias("mode"), origin.alias("origin"), secondary.alias("secondary_signal"))

    anchor = F.col("anchor")
    rows = F.array_compact(F.array(
        spec(0, anchor, F.array().cast("array<string>"), "static", F.lit("paper_literal"), none),
        F.when(F.col("guard").isNotNull(), spec(1, anchor, guards, "static", F.lit("paper_literal_with_guard"), none)),
        F.when(F.col("alternate").isNotNull(), spec(2, F.col("alternate"), guards, "dynamic", F.concat(F.lit("generalized_from:"), anchor), none)),
        F.when(F.col("secondary").isNotNull(), spec(3, anchor, guards, "dynamic", F.lit("augmented_with_secondary_signal"), F.col("secondary"))),
    ))
    shared = ("paper_id", "timeframe", "entry_trigger_primitive", "exit_trigger_primitive", "indicators", "risk_annotations")
    every = known.select(*shared, F.explode(rows).alias("s")).select(*shared, "s.*")
    same = Window.partitionBy("paper_id", "target_asset", "timeframe", "tier").orderBy("origin", "entry_trigger_primitive", "exit_trigger_primitive", F.to_json("indicators"))
    by_tier = Window.partitionBy("paper_id").orderBy("tier", "target_asset", "timeframe")
    first = every.withColumn("_n", F.row_number().over(same)).where("_n = 1").withColumn("_n", F.row_number().over(by_tier))
    return first.where(F.col("_n") <= MOST_SPECS).drop("_n")


SPEC_KEYS = ("paper_id", "timeframe", "entry_trigger_primitive", "exit_trigger_primitive", "indicators", "risk_annotations", "tier", "target_asset", "filter_primitives", "mode", "origin", "secondary_signal")


def export_specs(specs: DataFrame, path: str) -> DataFrame:
    """Write specifications as JSON lines and read them back; raises if they are not what was written."""
    rows = specs.select(*SPEC_KEYS)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    back = rows.sparkSession.read.schema(rows.schema).json(path)
    if not rows.exceptAll(back).isEmpty() or not back.exceptAll(rows).isEmpty():
        raise ValueError(f"{path} does not read back as it was written")
    return back


# --- variants of a specification
#
# specs: spec_id, target_asset, timeframe, entry_trigger_primitive, exit_trigger_primitive, sizing (a component's id),
# primitives (array of what the specification names), signal_ast (JSON), params (map of "pillar.name" to a value).

SPEC_FIELDS = "spec_id string, target_asset string, timeframe string, entry_trigger_primitive string, exit_trigger_primitive string, sizing string, primitives array<string>, signal_ast string, params map<string,double>"


def component_rows(spark: SparkSession, manifest: str | None = None) -> DataFrame:
    """(component_id, pillar, implements) of all components."""
    return spark.createDataFrame([(c.id, c.pillar, list(c.implements)) for c in load_manifest(manifest).values()], "component_id string, pillar string, implements array<string>")


def grid_rows(spark: SparkSession, manifest: str | None = None) -> DataFrame:
    """(component_id, param, default, lo, hi, step) of all components' parameters."""
    rows = [(c.id, name, *(g[k] for k in ("default", "lo", "hi", "step"))) for c in load_manifest(manifest).values() for name, g in pillar_grid(c).items()]
    return spark.createDataFrame(rows, "component_id string, param string, default double, lo double, hi double, step double")


def spec_variants(specs: DataFrame, components: DataFrame) -> DataFrame:
    """(spec_id, variant, entry, exit, sizing): up to MOST_VARIANTS combinations of components for each specification.

    A pillar's components come in order of whether they implement the trigger, then by id; variant i takes the i-th of
    each pillar, or the first where a pillar has fewer.  A pillar without components, or a sizing that is none, is null.
    """
    asked = specs.select("spec_id", F.explode(F.array(*(F.struct(F.lit(p).alias("pillar"), F.col(f"{p}_trigger_primitive").alias("trigger")) for p in ("entry", "exit")))).alias("a")).select("spec_id", "a.*")
    ranked = asked.join(components, "pillar").select("spec_id", "pillar", F.struct((~F.coalesce(F.array_contains("implements", F.col("trigger")), F.lit(False))).alias("other"), "component_id").alias("c"))
    lists = ranked.groupBy("spec_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("pillar") == p, F.col("c"))))["component_id"].alias(f"_{p}") for p in ("entry", "exit")))
    sizings = components.where("pillar = 'sizing'").select(F.col("component_id").alias("sizing"), F.lit(True).alias("_known"))
    every = specs.select("spec_id", "sizing").join(lists, "spec_id", "left").join(sizings, "sizing", "left")
    most = F.least(F.lit(MOST_VARIANTS), F.greatest(F.coalesce(F.size("_entry"), F.lit(0)), F.coalesce(F.size("_exit"), F.lit(0))))
    numbered = every.where(most > 0).select("*", F.explode(F.sequence(F.lit(0), most - 1)).alias("variant"))
    pick = lambda p: F.coalesce(F.get(f"_{p}", F.col("variant")), F.get(f"_{p}", F.lit(0))).alias(p)
    return numbered.select("spec_id", "variant", pick("entry"), pick("exit"), F.when(F.col("_known"), F.col("sizing")).alias("sizing"))


def unbacked(specs: DataFrame, components: DataFrame) -> DataFrame:
    """(spec_id, primitive): what a specification names that is no feed, no column and in no component."""
    spark = specs.sparkSession
    named = F.array_union(F.array_union(F.coalesce("primitives", F.array().cast("array<string>")), F.array("entry_trigger_primitive", "exit_trigger_primitive")), _tree("ids", F.col("signal_ast")))
    known = spark.createDataFrame([(x,) for x in sorted({*FEEDS, *OHLCV, "literal"})], "primitive string").unionByName(components.select(F.explode("implements").alias("primitive")))
    return specs.select("spec_id", F.explode(named).alias("primitive")).where("primitive is not null").distinct().join(known.distinct(), "primitive", "left_anti").select("spec_id", "primitive")


def _tree(what: str, json: Column) -> Column:
    """Array of the ids in a signal tree, or of its operators that look ahead; trees are small, a text a row."""
    import json as j

    read = (lambda t: sorted(primitive_ids(t))) if what == "ids" else look_ahead

    def compute(trees: pd.Series) -> pd.Series:
        return pd.Series([read(j.loads(t)) if t else [] for t in trees], dtype="object")

    return F.pandas_udf(compute, "array<string>")(json)


def spec_findings(specs: DataFrame, variants: DataFrame, components: DataFrame, grids: DataFrame) -> DataFrame:
    """(spec_id, variant, rule, severity, pillar, subject): each rule that a specification or one of its variants breaks.

    About a specification (variant is -1): no asset or no known timeframe, primitives that nothing implements, a
    signal that reads the future.  About a variant: no registered component for a pillar, parameters whose grid is not
    lo < hi with a positive step around the value, parameters without bounds, a slow span that is not above the fast.
    """
    none, text = F.lit(-1), F.lit(None).cast("string")

    def rule(rows: DataFrame, name: str, severity: str, variant: Column = none, pillar: Column = text, subject: Column = text) -> DataFrame:
        return rows.select("spec_id", variant.alias("variant"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), pillar.alias("pillar"), subject.alias("subject"))

    bad_time = F.coalesce(F.col("target_asset"), F.lit("")).eqNullSafe("") | ~F.coalesce(F.col("timeframe").isin(*GRANULARITIES), F.lit(False))
    pillars = variants.select("spec_id", "variant", F.explode(F.array(*(F.struct(F.lit(p).alias("pillar"), F.col(p).alias("component_id")) for p in PILLARS))).alias("p")).select("spec_id", "variant", "p.*")
    held = pillars.join(components.select("component_id", "pillar", F.lit(True).alias("there")), ["component_id", "pillar"], "left")
    values = held.where("there").join(grids, "component_id").join(specs.select("spec_id", "params"), "spec_id").withColumn("value", F.coalesce(F.try_element_at("params", F.concat_ws(".", "pillar", "param")), F.col("default")))
    off = (F.col("lo") >= F.col("hi")) | (F.coalesce("step", F.lit(0.0)) <= 0) | ~F.col("value").between(F.col("lo"), F.col("hi"))
    spans = values.where("component_id = 'entry.ema_cross'").groupBy("spec_id", "variant").agg(*(F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in ("fast", "slow")))
    ahead = specs.select("spec_id", F.explode(_tree("ahead", F.col("signal_ast"))).alias("term")).distinct()
    v, p, param = F.col("variant"), F.col("pillar"), F.concat_ws(".", "component_id", "param")
    return reduce(DataFrame.unionByName, [
        rule(specs.where(bad_time), "bad_data", "critical"),
        rule(unbacked(specs, components), "unbacked_primitive", "critical", subject=F.col("primitive")),
        rule(ahead, "lookahead_bias", "critical", subject=F.col("term")),
        rule(held.where("there is null"), "missing_pillar", "high", v, p, F.col("component_id")),
        rule(values.where("lo is null or hi is null"), "unbounded_param", "medium", v, p, param),
        rule(values.where(off), "grid_bounds", "high", v, p, param),
        rule(spans.where("slow <= fast"), "degenerate_window", "high", v, F.lit("entry")),
    ])


#: What the platform offers, as rows (fixed values).
CAPABILITIES = (
    ("crypto_market_data", "data", "L3", ("crypto_ohlcv", "orderbook", "trades", "funding_rates", "open_interest")),
    ("equity_market_data", "data", "unsupported", ("equity_ohlcv", "dividends", "corporate_actions")),
    ("macro_rates_data", "data", "unsupported", ("treasury_yields", "central_bank_rates", "term_structure")),
    ("vectorized_backtest", "compute", "in-process", ("vectorized indicators", "combinatorial purged cross-validation", "parameter sweep", "risk guardrails")),
    ("ml_inference", "compute", "unsupported", ("neural_network", "gradient_boosting", "llm_in_loop")),
    ("crypto_domain", "domain", "24/7", ("perpetual_futures", "funding_rate_analog", "instant_settlement", "staking_yield", "rfq_otc_desk")),
)


def capabilities(spark) -> DataFrame:
    return spark.createDataFrame([(n, k, g, list(p)) for n, k, g, p in CAPABILITIES], "name string, type string, granularity string, primitives array<string>")


def vocabulary() -> dict[str, list[str]]:
    """Names that specifications may use."""
    return {"indicators": feed_ids(), "triggers": ["TRIGGER_CROSS_ABOVE", "TRIGGER_CROSS_BELOW", "TRIGGER_BAND_BREAKOUT"], "filters": ["FLT_TIME_OF_DAY", "FLT_VOLATILITY_THRESHOLD", "FLT_VOLUME_RATIO"], "data_series": list(OHLCV)}
