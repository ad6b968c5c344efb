"""Joins on time: the last row before, and overlapping intervals.

Both deal rows to (key, time bucket), so a key with any share of the rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(c: Column) -> Column:
    """A timestamp (with or without a zone) as seconds."""
    return F.unix_micros(c.cast("timestamp")) / 1e6


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, columns: list[str], width: float, strict: bool = False, tie: str | None = None, within: float | None = None) -> DataFrame:
    """left with ``columns`` of the last row of right by time that is not later (with ``strict``: earlier), of equal ``by``.

    at, right_at: timestamps.  tie: of right rows at one time the one with the largest ``tie`` counts.  within: rows
    older than so many seconds don't.  Left rows without a match, or whose key or time is null, stay with nulls.

    Both sides meet in buckets of ``width`` seconds, where the last right row so far is carried along by time; what
    comes from before a bucket is one row per bucket of right, carried on to the buckets after it.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = [f"_k{i}" for i in range(len(by))]
    bucket = lambda c: F.floor(c / (width * 1e6))
    found = F.struct(micros(right_at).alias("t"), *([F.col(tie).alias("tie")] if tie else []), F.struct(*columns).alias("v"))
    rows = right.where(micros(right_at).isNotNull()).select(*(F.col(b).alias(k) for b, k in zip(by, keys)), micros(right_at).alias("_t"), found.alias("_r"))
    known = F.col(at).isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    whole = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_left")
    asked = left.where(known).select(*(F.col(b).alias(k) for b, k in zip(by, keys)), micros(at).alias("_t"), whole, F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"))
    # At one time right rows come before left ones, unless they have to be earlier.
    both = rows.select(*keys, "_t", F.lit(None).cast(asked.schema["_left"].dataType).alias("_left"), "_r").unionByName(asked)
    both = both.withColumn("_b", bucket(F.col("_t"))).withColumn("_side", F.col("_left").isNotNull() != F.lit(strict))
    here = Window.partitionBy(*keys, "_b").orderBy("_t", "_side", *([F.col("_r.tie")] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("_last", F.last("_r", True).over(here))
    # A row per bucket; max_by over (time, tie).
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", *([F.col("_r.tie")] if tie else [])))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_b", F.last("_end", True).over(before).alias("_before"))
    out = marked.where(F.col("_left").isNotNull()).join(carried, [*keys, "_b"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    fresh = F.lit(True) if within is None else F.col("_t") - F.col("_last.t") <= within * 1e6
    value = F.when(fresh, F.col("_last.v"))
    matched = out.select("_left.*", *(value[c].alias(c) for c in columns))
    alone = left.where(~known).select(*(F.col(f"`{c}`") for c in left.columns), *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns))
    return matched.unionByName(alone)


def overlapping(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, width: float, out: str = "overlaps") -> DataFrame:
    """left with ``out``: whether any interval of right with equal ``by`` overlaps its own; ends count, null keys and ends
    overlap nothing.

    start, end: columns of both sides, in seconds.  Intervals go to every bucket of ``width`` seconds that they touch, so
    two that overlap share one.  There the latest end of all right intervals that begin no later than a left one ends is
    carried along: no pair of rows is made, whatever overlaps.  Long intervals want wide buckets.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    id = next(n for n in ("_id", "_id_", "_id__") if n not in left.columns)
    named = left.withColumn(id, F.monotonically_increasing_id())

    def dealt(df: DataFrame, *more: Column) -> DataFrame:
        a, b = F.col(start).cast("double"), F.col(end).cast("double")
        some = df.dropna(subset=list(by)).where(a <= b).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), a.alias("_a"), b.alias("_z"), *more)
        return some.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_z") / width))))

    asks = dealt(named, F.col(id).alias("_id")).select(*keys, "_b", F.col("_z").alias("_p"), F.lit(1).alias("_side"), F.col("_a"), F.lit(None).cast("double").alias("_e"), "_id")
    has = dealt(right).select(*keys, "_b", F.col("_a").alias("_p"), F.lit(0).alias("_side"), F.lit(None).cast("double").alias("_a"), F.col("_z").alias("_e"), F.lit(None).cast("long").alias("_id"))
    w = Window.partitionBy(*keys, "_b").orderBy("_p", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = asks.unionByName(has).withColumn("_hit", F.max("_e").over(w) >= F.col("_a")).where("_side = 1").groupBy(F.col("_id").alias("_of")).agg(F.max("_hit").alias("_hit"))
    return named.join(hit, named[id] == hit["_of"], "left").select(*(named[c] for c in left.columns), F.coalesce(hit["_hit"], F.lit(False)).alias(out))


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str, *aggregates: Column) -> DataFrame:
    """One row per session: keys, start, end (of the last row plus the gap), rows, and ``aggregates``.

    A session goes on while rows of its keys follow within ``gap``.  On a stream behind a watermark a late row joins or
    merges sessions that are still open; one behind the watermark is dropped.
    """
    w = F.session_window(ts, gap)
    made = df.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("rows"), *aggregates)
    return made.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(F.col(f"`{c}`") for c in made.columns if c not in (*keys, "w")))
