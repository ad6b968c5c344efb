"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document of a source that is to be taken r times over gets floor(r) whole copies for certain; the fraction left is
its inclusion probability for one copy more.  Documents are ranked by the odds of a random number over the odds of that
probability, and the first of them are taken until the source's words reach its target.

The cut in the ranking is found without sorting a source: words per source and rank bin (at most BINS rows a source),
then again inside the one bin that holds the cut, and only what is left there, some 1/BINS^2 of a source, is ordered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, text_of

BINS = 4096
#: Tables with a row per source are broadcast up to so many sources; beyond, joins shuffle and adaptive execution splits the hot source.
FEW_SOURCES = 20_000
RANDOM_BITS = 52


def random_of(id: str, seed: str) -> Column:
    """A number in [0, 2^52) from the id alone, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def allocate(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words split by weight, no source above ``most`` times its own.

    Sources count by code point, null last, and the weights repeat.  What is above the limit goes to the others by
    weight until none is above: sources fill in order of limit over weight, so running sums give the level at once.
    totals has one row per source, which is why windows without a partition are fine here.
    """
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double")
    rated = totals.withColumn("w", w).withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = rated.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("w"), "source", "level"))).over(every)["level"]
    return levels.select("source", "source_size", F.when(F.col("full") | F.col("limit").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("w") * final)).alias("target"))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", weight: str | None = None, odds: Column | Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies (long) and taken (copies * size).

    size is the number of words (null text: 0).  ``weight`` may name a column of relative document weights (null: 1);
    a document's expected copies are then in proportion to it, ``most`` at most.  ``odds`` may multiply the inclusion
    odds of a document's copy beyond the certain ones (null: 1): what a source takes in all stays the same.  It is a
    column over df, or a function of the size, for which no text is read a second time.  Rows with the same id, rank and size
    (repeated rows) are taken or left together.  A source's words miss its target by at most half of the document at
    the cut.  A null source is a source; an empty table gives no rows.
    """
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(0.0))
    sized = cut(df.select(F.col(id).alias("id"), F.col(source).alias("source"), count_words(text_of(text)).alias("size"), own.alias("own"), random_of(id, seed).alias("r"), F.coalesce((odds if isinstance(odds, Column) else F.lit(1.0)).cast("double"), F.lit(1.0)).alias("odds")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("own")).alias("weighted"))
    plan = totals.join(allocate(totals.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s2").drop("source_size"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = cut(plan)
    few = plan.count() <= FEW_SOURCES
    side = lambda df: F.broadcast(df) if few else df
    u = (F.col("r") + 0.5) / float(1 << RANDOM_BITS)
    rate = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(0.0)
    expected = F.least(F.lit(float(most)), F.col("rate") * F.col("own"))
    p = F.col("expected") - F.floor("expected")
    factor = F.coalesce(odds(F.col("size")).cast("double"), F.lit(1.0)) if callable(odds) and not isinstance(odds, Column) else F.col("odds")
    rank = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")) * factor))
    ranked = sized.join(side(plan.withColumn("rate", rate).withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    ranked = ranked.withColumn("expected", expected).withColumn("base", F.floor("expected").cast("long")).withColumn("p", p).withColumn("rank", rank)
    # 0 to 1, rising with the rank; documents without a fraction come last and get no more.
    ranked = ranked.withColumn("place", F.col("rank") / (1 + F.col("rank"))).withColumn("bin", F.floor(F.col("place") * BINS)).withColumn("bin2", F.floor((F.col("place") * BINS - F.col("bin")) * BINS))
    ranked = cut(ranked.select("id", "source", "size", "source_size", "target", "base", "rank", "r", "bin", "bin2"))

    key = ["source"]
    base = ranked.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("base") * F.col("size")).alias("sure"))
    need = base.select(F.col("source").alias("s2"), (F.col("target") - F.col("sure")).alias("need"))
    open_rows = ranked.where("rank is not null and size > 0")

    def crossing(sums: DataFrame, need: DataFrame, at: str) -> DataFrame:
        """Per source the bin in which the running sum passes what is needed, and what is needed of it."""
        w = Window.partitionBy("source").orderBy(at)
        run = sums.withColumn("upto", F.sum("words").over(w))
        short = run.join(side(need), F.col("source").eqNullSafe(F.col("s2"))).where(F.col("upto") > F.col("need"))
        first = short.groupBy("source").agg(F.min(F.struct(at, "upto", "words", "need")).alias("x"))
        return first.select(F.col("source").alias("s2"), F.col(f"x.{at}").alias(f"cut_{at}"), (F.col("x.need") - F.col("x.upto") + F.col("x.words")).alias("need"))

    one = crossing(open_rows.groupBy(*key, "bin").agg(F.sum("size").alias("words")), need, "bin")
    inside = open_rows.join(side(one.withColumnRenamed("s2", "s1").drop("need")), F.col("source").eqNullSafe(F.col("s1")) & (F.col("bin") == F.col("cut_bin"))).drop("s1", "cut_bin")
    two = crossing(inside.groupBy(*key, "bin2").agg(F.sum("size").alias("words")), one.select("s2", "need"), "bin2")
    last = inside.join(side(two.withColumnRenamed("s2", "s1")), F.col("source").eqNullSafe(F.col("s1")) & (F.col("bin2") == F.col("cut_bin2")))
    # Equal rows are summed first; then the place in the order at which the words come nearest to what is needed.
    tied = last.groupBy("source", "rank", "r", "id", "size", "need").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("rank", "r", F.col("id").asc_nulls_first(), "size")
    upto = tied.withColumn("upto", F.sum("words").over(w))
    taken = upto.where((F.col("upto") - F.col("need")) <= (F.col("need") - (F.col("upto") - F.col("words"))))
    cuts = one.select("s2", "cut_bin").join(two.select(F.col("s2").alias("s1"), "cut_bin2"), F.col("s2").eqNullSafe(F.col("s1")), "left").drop("s1")
    ends = taken.groupBy("source").agg(F.max(F.struct("rank", "r", "id", "size")).alias("end")).withColumnRenamed("source", "s1")
    cuts = cuts.join(ends, F.col("s2").eqNullSafe(F.col("s1")), "left").drop("s1")
    met = need.select(F.col("s2").alias("s0"), F.col("need").alias("want")).join(cuts, F.col("s0").eqNullSafe(F.col("s2")), "left").drop("s2")
    here = F.struct("rank", "r", "id", "size")
    extra = F.col("rank").isNotNull() & (F.col("want") > 0) & (
        F.col("cut_bin").isNull()  # the whole source is not too much
        | (F.col("bin") < F.col("cut_bin"))
        | ((F.col("bin") == F.col("cut_bin")) & ((F.col("bin2") < F.col("cut_bin2")) | ((F.col("bin2") == F.col("cut_bin2")) & F.coalesce(here <= F.col("end"), F.lit(False)))))
    )
    out = ranked.join(side(met), F.col("source").eqNullSafe(F.col("s0")))
    copies = F.col("base") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
