"""From feed requests to one lazy DataFrame.

Builders name steps; equal steps are shared.  A step is a column expression (windows over earlier columns included) or
a kernel, a numpy function over one series.  Column phases alternate with kernel phases; a column phase is as few selects
as its windows allow (window over window needs another select), and each kernel phase is one grouped map, so a request
costs one shuffle on the series and one Arrow round trip however many feeds it has.

With ``block`` no task holds a series (see blocks.py): windows, cumulative frames and scans run on (series, block).
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions.columns import safe_div

#: Row number in the series, block and rows of the series, where a plan works on blocks.
ROW, BLOCK, TOTAL, HEAD = "_row", "_block", "_total", "_head_"
#: Frames from here on take their extremes from two lookups a row.
LONG_FRAME = 64


@dataclass
class Step:
    """kind: col (an expression), cum and whole (aggregates over all rows so far, and over all), scan (a recursion
    y += k (x - y)), map (numpy, of the same bar only), local (numpy, of ``back`` bars before), machine (numpy with state).

    linear: whether values are a linear function of the states of scans of the same phase; None: they depend on none.
    """

    names: tuple[str, ...]
    kind: str
    deps: tuple[str, ...]
    make: Callable
    stage: int = 0
    phase: int = 0
    level: int = 0
    back: int = 0
    linear: bool | None = None
    more: dict = field(default_factory=dict)


class Plan:
    """Steps over a DataFrame of bars: ``keys`` name a series, ``order`` sorts it (unique within one).

    block: a column (or SQL expression) that does not fall as ``order`` rises (a day, say), by which rows are first dealt out; then blocks
    have ``rows`` rows each.
    """

    def __init__(self, keys: tuple[str, ...] = ("symbol",), order: str = "ts", block: Column | str | None = None, rows: int = 65_536):
        self.keys, self.order, self.block, self.rows = tuple(keys), order, block, rows
        self.window = Window.partitionBy(*self.keys).orderBy(order) if block is None else Window.partitionBy(*self.keys, BLOCK).orderBy(ROW)
        self.steps: dict[str, Step] = {}
        self.known: dict[Hashable, tuple[str, ...]] = {}
        self.formulas: dict[str, tuple[Callable, tuple[str, ...], Hashable]] = {}

    # --- steps

    def _place(self, deps: tuple[str, ...], kind: str) -> tuple[int, int, int]:
        """(stage, phase, level).  Machines begin a stage of their own on blocks; else they are kernels like others."""
        before = [self.steps[d] for d in deps if d in self.steps]
        stage = max([0, *(s.stage for s in before)])
        if kind == "machine" and self.block is not None:
            return stage + 1, -1, 0
        same = [s for s in before if s.stage == stage and s.phase >= 0]
        if kind == "col":
            phase = max([0, *(s.phase + s.phase % 2 for s in same)])
            return stage, phase, 1 + max([0, *(s.level for s in same if s.phase == phase)])
        if kind in ("cum", "whole") and self.block is not None:
            return stage, max([1, *(s.phase + 1 + s.phase % 2 for s in same)]), 0
        if kind == "scan" and self.block is not None:
            # A scan of scans is one linear map of all their states; what is not linear has to be known before.
            behind = lambda s, i: s.phase % 2 and (s.linear is False or i > 0 and s.linear is not None)
            return stage, max([1, *(s.phase + 2 if behind(s, i) else s.phase + 1 - s.phase % 2 for i, d in enumerate(deps) if (s := self.steps.get(d)) in same)]), 0
        return stage, max([1, *(s.phase + 1 - s.phase % 2 for s in same)]), 0

    def _add(self, key: Hashable, kind: str, deps: tuple[str, ...], make: Callable, outputs: int = 1, back: int = 0, **more) -> tuple[str, ...]:
        if key not in self.known:
            names = tuple(f"_{len(self.known)}_{i}" for i in range(outputs)) if outputs > 1 else (f"_{len(self.known)}",)
            place = self._place(deps, kind)
            step = Step(names, kind, tuple(deps), make, *place, back, self._linear(deps, kind, place, more), more)
            self.steps |= dict.fromkeys(names, step)
            self.known[key] = names
        return self.known[key]

    def _linear(self, deps: tuple[str, ...], kind: str, place: tuple[int, int, int], more: dict) -> bool | None:
        if kind == "scan":
            return True
        known = [s.linear for d in deps if (s := self.steps.get(d)) is not None and (s.stage, s.phase) == place[:2] and s.kind in ("scan", "map", "local")]
        known = [x for x in known if x is not None]
        return all(known) and more.get("sums", False) if known else None

    def col(self, key: Hashable, deps: tuple[str, ...], make: Callable[[], Column], back: int = 0) -> str:
        """A column from the columns ``deps`` of this bar and of ``back`` bars before; ``key`` tells equal steps."""
        return self._add(key, "col", deps, make, back=back)[0]

    def kernel(self, key: Hashable, deps: tuple[str, ...], run: Callable, outputs: int = 1, back: int = 0, sums: bool = False) -> tuple[str, ...]:
        """``outputs`` columns from run(*arrays of deps), an array or a tuple of them, each value from its own bar and
        ``back`` bars before.  A dep named ROW is the row number in the series; ``sums``: run only adds multiples of deps."""
        return self._add((key, deps), "local" if back else "map", deps, run, outputs, back, sums=sums)

    def machine(self, key: Hashable, deps: tuple[str, ...], run: Callable, outputs: int = 1) -> tuple[str, ...]:
        """``outputs`` columns from run(state, *arrays of deps), which returns them and the state for the bars after."""
        return self._add((key, deps), "machine", deps, run, outputs)

    # --- window primitives; all or nothing: NULL until n values are there

    def frame(self, n: int):
        return self.window.rowsBetween(-(n - 1), 0)

    def roll(self, how: str, x: str, n: int) -> str:
        n = max(int(n), 2 if how == "stddev_pop" or how == "var_pop" else 1)
        agg = getattr(F, how)
        return self.col((how, x, n), (x,), lambda: F.when(F.count(x).over(self.frame(n)) == n, agg(x).over(self.frame(n))), n - 1)

    def mean(self, x: str, n: int) -> str:
        return self.roll("avg", x, n)

    def sum(self, x: str, n: int) -> str:
        return self.roll("sum", x, n)

    def std(self, x: str, n: int) -> str:
        return self.roll("stddev_pop", x, n)

    def place(self) -> str:
        """The row number in the series, from 0."""
        return self.col("row", (), lambda: (F.row_number().over(self.window) - 1).cast("long")) if self.block is None else ROW

    def extreme(self, how: str, x: str, n: int) -> str:
        """A rolling maximum or minimum.  A long frame lies over at most two runs of n rows: the end of one and the
        beginning of the next, whose extremes are running ones, so a row costs the same for any n."""
        n = max(int(n), 1)
        if n < LONG_FRAME:
            return self.roll(how, x, n)
        agg, pick, row = getattr(F, how), F.greatest if how == "max" else F.least, self.place()
        keys = self.keys if self.block is None else (*self.keys, BLOCK)
        run = self.col(("run", n), (row,), lambda: F.floor(F.col(row) / n))
        within = Window.partitionBy(*keys, run).rowsBetween(Window.unboundedPreceding, 0)
        head = self.col(("head", how, x, n), (x, run, row), lambda: agg(x).over(within.orderBy(row)), n - 1)
        tail = self.col(("tail", how, x, n), (x, run, row), lambda: agg(x).over(within.orderBy(F.desc(row))))
        known = self.col(("count", x), (x,), lambda: F.count(x).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))

        def make() -> Column:
            full = (F.col(known) - F.coalesce(F.lag(known, n).over(self.window), F.lit(0)) == n) & F.lag(row, n - 1).over(self.window).isNotNull()
            return F.when(full, pick(F.col(head), F.lag(tail, n - 1).over(self.window)))

        return self.col((how, x, n), (x, head, tail, known, row), make)

    def high(self, x: str, n: int) -> str:
        return self.extreme("max", x, n)

    def low(self, x: str, n: int) -> str:
        return self.extreme("min", x, n)

    def running(self, how: str, x: str) -> str:
        """An aggregate (sum, max, min, avg, count, last) of all values so far."""
        if how == "avg" and self.block is not None:
            return self.expr(F.try_divide, self.running("sum", x), self.running("count", x), key="mean so far")
        so_far = self.window.rowsBetween(Window.unboundedPreceding, 0)
        make = lambda: (F.last(x, True) if how == "last" else getattr(F, how)(x)).over(so_far)
        return self.col(("running", how, x), (x,), make) if self.block is None else self._add(("running", how, x), "cum", (x,), make, how=how)[0]

    def whole_mean(self, x: str) -> str:
        """The mean over the whole series, later bars included."""
        make = lambda: F.avg(x).over(Window.partitionBy(*self.keys))
        return self.col(("whole mean", x), (x,), make) if self.block is None else self._add(("whole mean", x), "whole", (x,), make)[0]

    def first(self, x: str) -> str:
        """The value at the series' first bar."""
        if self.block is None:
            return self.col(("first", x), (x,), lambda: F.first(x).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))
        if x in self.formulas:
            make, deps, key = self.formulas[x]
            return self.expr(make, *map(self.first, deps), key=("first", key))
        if x not in self.steps:
            return HEAD + x
        return self._add(("first", x), "cum", (x,), None, how="first")[0]

    def lag(self, x: str, n: int = 1) -> str:
        n = max(int(n), 0)
        return x if n == 0 else self.col(("lag", x, n), (x,), lambda: F.lag(x, n).over(self.window), n)

    def shift(self, x: str, n: int = 1) -> str:
        """n bars ago; before that the first value."""
        if int(n) <= 0:
            return x
        return self.expr(lambda a, b: F.coalesce(a, b), self.lag(x, n), self.first(x), key="shift")

    def change(self, x: str) -> str:
        """First difference, 0 at the first bar."""
        return self.expr(lambda a, b: F.coalesce(a - b, F.lit(0.0)), x, self.lag(x), key="change")

    def pct_change(self, x: str, n: int = 1) -> str:
        """Change over n bars in percent; 0 for the first n bars and where the price was 0."""
        return self.expr(lambda a, b: (safe_div(a, b, 1.0) - 1) * 100, x, self.shift(x, n), key="pct")

    def wma(self, x: str, n: int) -> str:
        """Weights 1 to n, the newest heaviest."""
        n = max(int(n), 1)
        if n == 1:
            return x

        def make() -> Column:
            terms = F.col(x) * n
            for k in range(1, n):
                terms = terms + F.lag(x, k).over(self.window) * (n - k)
            return F.when(F.count(x).over(self.frame(n)) == n, terms / (n * (n + 1) / 2))

        def make_long() -> Column:
            pairs = F.zip_with(F.collect_list(x).over(self.frame(n)), F.sequence(F.lit(1), F.lit(n)), lambda v, w: v * w)
            return F.when(F.count(x).over(self.frame(n)) == n, F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / (n * (n + 1) / 2))

        return self.col(("wma", x, n), (x,), make if n <= 64 else make_long, n - 1)

    def mean_dev(self, x: str, n: int) -> str:
        """Mean over n of |x - its mean over n|, each at its own bar."""
        return self.mean(self.expr(lambda a, m: F.abs(a - m), x, self.mean(x, n), key="dev"), n)

    def true_range(self) -> str:
        make = lambda h, lo, p: F.when(p.isNull(), h - lo).otherwise(F.greatest(h - lo, F.abs(h - p), F.abs(lo - p)))
        return self.expr(make, "high", "low", self.lag("close"), key="tr")

    def stochastic_k(self, n: int, high: str = "high", low: str = "low", close: str = "close") -> str:
        make = lambda c, lo, hi: safe_div(c - lo, hi - lo, 0.5) * 100
        return self.expr(make, close, self.low(low, n), self.high(high, n), key="stoch")

    def expr(self, make: Callable[..., Column], *deps: str, key: Hashable) -> str:
        """A column by make(columns of deps) of the same bar; key names the formula."""
        name = self.col(("expr", key, deps), deps, lambda: make(*map(F.col, deps)))
        self.formulas[name] = (make, deps, key)
        return name

    # --- recursions

    def scan(self, x: str, alpha: float) -> str:
        alpha = min(max(float(alpha), 0.0), 1.0)
        return self._add(("scan", x, alpha), "scan", (x,), lambda a: K.scan_on(a, alpha), k=alpha)[0]

    def scan_step(self, x: str, k: str) -> str:
        """A scan with a coefficient, clipped to [0, 1], for each bar."""
        return self._add(("scan", x, k), "scan", (x, k), K.scan_on, k=None)[0]

    def ema(self, x: str, span: int) -> str:
        return self.scan(x, 2.0 / (max(int(span), 1) + 1))

    def rma(self, x: str, n: int) -> str:
        return self.scan(x, 1.0 / max(int(n), 1))

    # --- execution

    def run(self, df: DataFrame, outputs: dict[str, str], keep: tuple[str, ...] | None = None) -> DataFrame:
        """df's columns ``keep`` (all, if None) and ``outputs`` (name: step or column), lazily."""
        keep = tuple(df.columns) if keep is None else keep
        wanted = self.needed(set(outputs.values()))
        if self.block is not None:
            from .blocks import run

            return run(self, df, wanted, outputs, keep)
        last = max([0, *(self.steps[n].phase for n in wanted if n in self.steps)])
        now = df
        for phase in range(last + 1):
            mine = [n for n in wanted if n in self.steps and self.steps[n].phase == phase]
            if phase % 2 == 0:
                now = self.columns(now, mine)
            elif mine:
                now = self._grouped(now, phase, wanted, outputs, keep)
        return self.shown(now, outputs, keep)

    def columns(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df with the column steps ``names``, a select for each level."""
        for level in sorted({self.steps[n].level for n in names}):
            df = df.select("*", *(self.steps[n].make().alias(n) for n in names if self.steps[n].level == level))
        return df

    def shown(self, df: DataFrame, outputs: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
        return df.select(*(F.col(f"`{c}`") for c in keep if c not in outputs), *(F.col(step).alias(name) for name, step in outputs.items()))

    def needed(self, names: set[str]) -> list[str]:
        """The steps behind names, inputs first."""
        seen: dict[str, None] = {}

        def visit(name: str) -> None:
            if name not in seen:
                for d in self.steps[name].deps if name in self.steps else ():
                    visit(d)
                seen[name] = None

        for name in sorted(names):
            visit(name)
        return list(seen)

    def _grouped(self, df: DataFrame, phase: int, wanted: list[str], outputs: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
        own = list({id(s): s for s in (self.steps[n] for n in wanted if n in self.steps) if s.phase == phase}.values())
        made = [n for s in own for n in s.names]
        later = {d for n in wanted if n in self.steps and self.steps[n].phase > phase for d in self.steps[n].deps} | set(outputs.values())
        inputs = {d for s in own for d in s.deps} - {*made, ROW}
        through = [c for c in df.columns if c in keep or c in self.keys or c == self.order or c in later]
        new = [n for n in made if n in later]
        schema = T.StructType([*(df.schema[c] for c in through), *(T.StructField(n, T.DoubleType()) for n in new)])
        order, steps = self.order, [(s.names, s.kind, s.deps, s.make) for s in own]

        def run(series: pd.DataFrame) -> pd.DataFrame:
            series = series.sort_values(order, kind="stable", ignore_index=True)
            values = {c: series[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs} | {ROW: np.arange(len(series))}
            for names, kind, deps, make in steps:
                args = [values[d] for d in deps]
                result = make(None, *args)[0] if kind == "machine" else make(*args)
                values |= dict(zip(names, result if isinstance(result, tuple) else (result,)))
            out = series[through].copy()
            for n in new:
                out[n] = values[n]
            return out

        return df.select(*dict.fromkeys([*through, *inputs])).groupBy(*self.keys).applyInPandas(run, schema)
