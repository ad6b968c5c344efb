"""Bars from ticks, and tables of known layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bar durations by granularity.
GRANULARITIES = {"1s": "1 second", "1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}


def to_bars(ticks: DataFrame, symbol: str, ts: str, price: str, id: str, granularity: str = "1h", volume: Column | None = None) -> DataFrame:
    """bars(symbol, ts, open, high, low, close, volume) of ticks; ``id`` breaks ties of ts.

    One hash aggregate: partial before the shuffle, so a task sends at most a row per symbol and bar.  volume is the
    number of ticks unless an aggregate is given.  Ticks without a price don't count.
    """
    start = F.window(F.col(ts), GRANULARITIES[granularity])["start"]
    order = F.struct(F.col(ts), F.col(id))
    value = F.col(price).cast("double")
    known = ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
    return known.groupBy(F.col(symbol).alias("symbol"), start.alias("ts")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"),
        (F.count("*") if volume is None else volume).cast("double").alias("volume"))


def tick_bars(ticks: DataFrame, symbol: str, ts: str, price: str) -> DataFrame:
    """Every tick as a bar of its own, of volume 1."""
    value = F.col(price).cast("double")
    return ticks.select(F.col(symbol).alias("symbol"), F.col(ts).alias("ts"), *(value.alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"))


def bar_sets(ticks: DataFrame, symbol: str, ts: str, price: str, id: str, coarser: tuple[str, ...] = ("1d",), finest: str = "1h") -> DataFrame:
    """Bars of several granularities from one read of the ticks: (symbol, granularity, ts, open, ..., volume).

    Ticks become states of the finest bars (first and last with their places, extremes, count), which merge; grouping
    sets roll them up by symbol and each coarser granularity, by symbol alone (granularity and ts null) and over
    everything (symbol null too).  Only states are multiplied by the sets.
    """
    value, place = F.col(price).cast("double"), F.struct(F.col(ts).alias("t"), F.col(id).alias("i"))
    start = lambda c, g: F.window(c, GRANULARITIES[g])["start"]
    known = ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
    states = known.groupBy(F.col(symbol).alias("symbol"), start(F.col(ts), finest).alias("t0")).agg(
        F.min(F.struct(place.alias("at"), value.alias("v"))).alias("first"), F.max(F.struct(place.alias("at"), value.alias("v"))).alias("last"), F.max(value).alias("high"), F.min(value).alias("low"), F.count("*").alias("n"))
    grains = (finest, *coarser)
    for i, g in enumerate(coarser, 1):
        states = states.withColumn(f"t{i}", start(F.col("t0"), g))
    every = [f"t{i}" for i in range(len(grains))]
    sets = [*([F.col("symbol"), F.col(t)] for t in every), [F.col("symbol")], []]
    rolled = states.groupingSets(sets, F.col("symbol"), *map(F.col, every)).agg(
        F.min("first")["v"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last")["v"].alias("close"), F.sum("n").cast("double").alias("volume"))
    grain = F.coalesce(*(F.when(F.col(t).isNotNull(), g) for t, g in zip(every, grains)))
    return rolled.where(F.col("volume") > 0).select("symbol", grain.alias("granularity"), F.coalesce(*every).alias("ts"), "open", "high", "low", "close", "volume")


def event_bars(spark: SparkSession, sf_dir: str, granularity: str = "1h") -> DataFrame:
    """Bars of the events table: a series per event type."""
    return to_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id", granularity)


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices: a series per priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return to_bars(orders, "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", "1d")
