"""Parameter grids, and evaluating many parameter sets of one series at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.planner import Plan
from .components import Component


def pillar_grid(component: Component) -> dict[str, dict[str, float]]:
    """default, lo, hi and step (a fifth of the range; 1 if that is 0) of each parameter."""
    return {name: {"default": float(b["default"]), "lo": float(b["min"]), "hi": float(b["max"]), "step": max(round((b["max"] - b["min"]) / 5.0, 6) or 1.0, 1e-9)} for name, b in component.params.items()}


def grid(spark: SparkSession, component: Component, most: int = 100_000) -> DataFrame:
    """One row per parameter set: param_id (by the parameters in order) and a double column for each parameter.

    The product of the axes is known here, and more than ``most`` sets are refused; axes are crossed as literal arrays.
    """
    axes = {name: [round(g["lo"] + i * g["step"], 6) for i in range(int((g["hi"] - g["lo"]) / g["step"] + 1e-9) + 1)] for name, g in pillar_grid(component).items()}
    total = math.prod(len(a) for a in axes.values())
    if total > most:
        raise ValueError(f"{total} parameter sets are more than {most}")
    out, radix = spark.range(total).withColumnRenamed("id", "param_id"), total
    for name, values in axes.items():
        radix //= len(values)
        at = (F.floor(F.col("param_id") / radix) % len(values)).cast("int")
        out = out.withColumn(name, F.get(F.array(*map(F.lit, values)), at))
    return out


def ema_cross_sweep(bars: DataFrame, fasts: list[int], slows: list[int], keys: tuple[str, ...] = ("symbol",), order: str = "ts", block: Column | str | None = None, rows: int = 65_536) -> DataFrame:
    """Per series and (fast, slow) with fast < slow: bars, entries up and down, and the mean one-bar return held.

    Each EMA is computed once per series, for all sets that use it, and a task sends on one row per set and series, not
    one per bar.  Held is the last entry's sign, from the bar after it.
    """
    plan, outputs, sets = Plan(keys, order, block, rows), {}, []
    outputs["gain"] = plan.expr(lambda c, b: (c - b) / F.when(b == 0, 1.0).otherwise(b), "close", plan.lag("close"), key="gain")
    for f in fasts:
        for s in slows:
            if f < s:
                apart = plan.expr(lambda a, b: a - b, plan.ema("close", f), plan.ema("close", s), key="diff")
                entry = plan.expr(lambda x, b: F.when((x > 0) & (b <= 0), 1.0).when((x < 0) & (b >= 0), -1.0), apart, plan.lag(apart), key="entry")
                names = f"entry_{f}_{s}", f"held_{f}_{s}"
                outputs |= dict(zip(names, (entry, plan.lag(plan.running("last", entry)))))
                sets.append(F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(names[0]).alias("entry"), F.col(names[1]).alias("held")))
    each = plan.run(bars, outputs, keys).select(*keys, "gain", F.inline(F.array(*sets)))
    return each.groupBy(*keys, "fast", "slow").agg(
        F.count("*").alias("bars"), F.count_if(F.col("entry") == 1).alias("ups"), F.count_if(F.col("entry") == -1).alias("downs"), F.avg(F.coalesce("held", F.lit(0.0)) * F.col("gain")).alias("mean_return"))


def surface_decay(results: DataFrame, value: str, by: list[str]) -> DataFrame:
    """How flat a parameter surface is: 1 - std / |mean| of a value over the parameter sets; NULL for a mean of 0."""
    return results.groupBy(*by).agg((1 - F.try_divide(F.stddev_pop(value), F.abs(F.avg(value)))).alias("surface_decay"))
