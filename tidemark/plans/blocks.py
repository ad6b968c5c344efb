"""Running a plan on blocks of rows, so that a series of any length is spread over tasks.

Rows are numbered within their series by two-level counts, and dealt to blocks of equal numbers of rows.  A block also
gets the last H rows of the one before (its halo), H being how far back the windows of the plan look in all, so windows
need nothing else.  What looks back without end goes on from the block before: a piece of a scan is a map of the state
before it, a piece of a cumulative frame an aggregate; one row per block is composed in order, and each block starts
from what it is given.

A step is exact from some row of the extended block on: its ``reach``.  Windows add to the reach of what they read.  A
scan's pieces are the B rows from its inputs' reach on, which lie end to end over the blocks, so its values are exact from
there, inside the halo too, and windows over scans and scans over windows nest.

Only state machines, whose steps do not compose, go through a series in order: rows are streamed in order of the series
with the machine's state, so a task holds a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from .planner import BLOCK, HEAD, ROW, TOTAL, Plan, Step

META = (ROW, TOTAL, BLOCK)


def number_rows(df: DataFrame, keys: tuple[str, ...], order: str, block: Column | str, heads: tuple[str, ...] = ()) -> DataFrame:
    """df with the row number in the series (from 0), its number of rows, and the values of ``heads`` at its first row.

    Rows meet by (keys, block) only; a row per block goes through a window of its series.
    """
    marked = df.withColumn(BLOCK, F.expr(block) if isinstance(block, str) else block)
    own = (*keys, BLOCK)
    first = F.min_by(F.struct(F.lit(0).alias("_"), *(F.col(h).cast("double").alias(h) for h in heads)), F.struct(order)).alias("_first")
    sizes = marked.groupBy(*own).agg(F.count("*").alias("_n"), first)
    w = Window.partitionBy(*keys)
    before = w.orderBy(BLOCK)
    starts = sizes.select(*own, F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias(TOTAL), F.first("_first").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("_first"))
    here = F.row_number().over(Window.partitionBy(*own).orderBy(order))
    placed = _with(marked, starts, own).withColumn(ROW, (F.col("_before") + here - 1).cast("long"))
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), ROW, TOTAL, *(F.col(f"_first.{h}").alias(HEAD + h) for h in heads))


def _with(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Left rows with right's columns, by equal names; null equals null."""
    other = right.select(*(F.col(n).alias(f"_by_{n}") for n in names), *(c for c in right.columns if c not in names))
    same = [F.col(n).eqNullSafe(F.col(f"_by_{n}")) for n in names]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return left.join(other, on, "left").drop(*(f"_by_{n}" for n in names))


def run(plan: Plan, df: DataFrame, wanted: list[str], outputs: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """See Plan.run."""
    steps = list({id(s): s for s in (plan.steps[n] for n in wanted if n in plan.steps)}.values())
    heads = tuple(n.removeprefix(HEAD) for n in wanted if n.startswith(HEAD) and n not in df.columns)
    now = number_rows(df, plan.keys, plan.order, plan.block, heads)
    for stage in range(1 + max([0, *(s.stage for s in steps)])):
        own = [s for s in steps if s.stage == stage]
        if machines := [s for s in own if s.phase < 0]:
            now = _machines(plan, _narrow(plan, now, (stage, -2), steps, outputs, keep), machines)
        if rest := [s for s in own if s.phase >= 0]:
            now = _stage(plan, now, stage, rest, steps, outputs, keep)
    return plan.shown(now, outputs, keep)


def _later(plan: Plan, at: tuple[int, int], steps: list[Step], outputs: dict[str, str]) -> set[str]:
    """What outputs and steps after (stage, phase) read."""
    return {d for s in steps if (s.stage, s.phase) > at for d in s.deps} | set(outputs.values())


def _narrow(plan: Plan, df: DataFrame, at: tuple[int, int], steps: list[Step], outputs: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """df without the columns that nothing after (stage, phase) reads."""
    some = {*keep, *plan.keys, *META, *_later(plan, at, steps, outputs)}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c in some))


def _stage(plan: Plan, df: DataFrame, stage: int, own: list[Step], steps: list[Step], outputs: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """All steps of a stage but machines: extended blocks, phase by phase, then the blocks' own rows."""
    reach: dict[str, int] = {}
    phases, starts = sorted({s.phase for s in own}), {}
    of = lambda s: max([0, *(reach.get(d, 0) for d in s.deps)])
    for phase in phases:
        mine = [s for s in own if s.phase == phase]
        carried = [s for s in mine if s.kind in ("scan", "cum", "whole")]
        starts[phase] = max([0, *map(of, carried)])
        for s in mine:  # inputs first
            reach |= dict.fromkeys(s.names, starts[phase] if s in carried else of(s) + s.back)
    after = {d for s in steps if s.stage > stage for d in s.deps} | set(outputs.values())
    halo = max([0, *(reach[n] for n in reach if n in after)])
    size = max(plan.rows, halo)

    home = F.floor(F.col(ROW) / size)
    also = (F.col(ROW) >= (home + 1) * size - halo) & ((home + 1) * size < F.col(TOTAL))
    now = _narrow(plan, df, (stage, -1), steps, outputs, keep).withColumn(BLOCK, F.explode(F.when(also, F.array(home, home + 1)).otherwise(F.array(home))) if halo else home)
    for phase in phases:
        mine = [s for s in own if s.phase == phase]
        if phase % 2 == 0:
            now = plan.columns(now, [n for s in mine for n in s.names])
            continue
        lower = lambda b, a=starts[phase]: b * size - halo + a
        # What a phase reads twice, for the pieces and for the rows, is one exchange.
        now = _narrow(plan, now, (stage, phase - 1), steps, outputs, keep).repartition(*plan.keys, BLOCK)
        source = now
        if some := [s for s in mine if s.kind in ("cum", "whole")]:
            now = _cumulated(plan, now, some, lower, size)
        if some := [s for s in mine if s.kind not in ("cum", "whole")]:
            later = _later(plan, (stage, phase), steps, outputs)
            now = _scanned(plan, source, now, some, lower, size, [c for c in now.columns if c in {*keep, *plan.keys, *META, *later}], later)
    return now.where(F.col(ROW) >= F.col(BLOCK) * size).drop(BLOCK) if halo else now.drop(BLOCK)


def _piece(lower, size: int) -> tuple[Column, Column]:
    """Whether a row of an extended block is exact, and whether it belongs to the block's piece."""
    b, row = F.col(BLOCK), F.col(ROW)
    exact = (b == 0) | (row >= lower(b))
    return exact, exact & ((row < lower(b) + size) | ((b + 1) * size >= F.col(TOTAL)))


def _cumulated(plan: Plan, df: DataFrame, steps: list[Step], lower, size: int) -> DataFrame:
    """df with cumulative aggregates, and aggregates over the whole series: block totals, then a window over blocks."""
    exact, piece = _piece(lower, size)
    value = lambda s: F.col(s.deps[0])
    totals = []
    for s in steps:
        n, x, how = s.names[0], F.when(piece, value(s)), s.more.get("how")
        if s.kind == "whole":
            totals += [F.sum(x).alias(f"{n}s"), F.count(x).alias(f"{n}c")]
        elif how == "first":
            totals.append(F.min_by(F.struct(x.alias("v")), F.when(piece, F.col(ROW))).alias(f"{n}t"))
        elif how == "last":
            totals.append(F.max_by(x, F.when(x.isNotNull(), F.col(ROW))).alias(f"{n}t"))
        else:
            totals.append(getattr(F, how)(x).alias(f"{n}t"))
    series = Window.partitionBy(*plan.keys)
    before = series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for s in steps:
        n, how = s.names[0], s.more.get("how")
        if s.kind == "whole":
            carried.append(F.try_divide(F.sum(f"{n}s").over(series), F.sum(f"{n}c").over(series)).alias(f"{n}t"))
        else:
            over = F.first(f"{n}t").over(before) if how == "first" else F.last(f"{n}t", True).over(before) if how == "last" else getattr(F, "sum" if how == "count" else how)(f"{n}t").over(before)
            carried.append(over.alias(f"{n}t"))
    by = (*plan.keys, BLOCK)
    joined = _with(df, df.groupBy(*by).agg(*totals).select(*by, *carried), by)
    so_far = plan.window.rowsBetween(Window.unboundedPreceding, 0)
    made = []
    for s in steps:
        n, how = s.names[0], s.more.get("how")
        old = F.col(f"{n}t")
        if s.kind == "whole":
            now = old
        elif how == "first":
            now = F.when(F.col(BLOCK) > 0, old["v"]).otherwise(F.first(value(s)).over(so_far))
        elif how == "last":
            now = F.coalesce(F.last(F.when(exact, value(s)), True).over(so_far), old)
        else:
            new = getattr(F, how)(F.when(exact, value(s))).over(so_far)
            now = {"max": F.greatest(old, new), "min": F.least(old, new)}.get(how, F.coalesce(old + new, old, new))
        made.append(now.alias(n))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *made)


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).cast(pa.float64()).to_numpy())


def _scanned(plan: Plan, source: DataFrame, df: DataFrame, steps: list[Step], lower, size: int, through: list[str], later: set[str]) -> DataFrame:
    """df's columns ``through`` with the scans, and the kernels on them, that ``later`` names; ``source``: df without what
    this phase has added."""
    keys, by = plan.keys, (*plan.keys, BLOCK)
    work = [(s.names, s.kind, s.deps, s.make, s.more.get("k")) for s in steps]
    scans = [names[0] for names, kind, *_ in work if kind == "scan"]
    made = {n for s in steps for n in s.names}
    inputs = [d for d in dict.fromkeys(d for s in steps for d in s.deps) if d not in made]
    new = [n for s in steps for n in s.names if n in later]
    rows = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*through, ROW, TOTAL, BLOCK, *inputs])))
    out = T.StructType([*(df.schema[c] for c in through), *(T.StructField(n, T.DoubleType()) for n in new)])

    def behind(names: set[str]) -> set[str]:
        """The steps of this phase that lead to ``names``."""
        for own, _, deps, *_ in reversed(work):
            if names & set(own):
                names = names | set(deps)
        return names

    upto = {n: behind({n}) & made for n in scans}
    leading = set().union(*upto.values())
    # (scan, scan that it is over)
    over = [(n, m) for n in scans for m in scans if m != n and m in upto[n]]

    def values_of(table: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
        return {n: _numbers(table, n) for n in names} | {ROW: table.column(ROW).to_numpy()}

    def through_steps(values: dict, scan, only: set[str]) -> dict:
        """values with those of the steps ``only``; scan(name, x, k) does the scans."""
        values = dict(values)
        for names, kind, deps, make, k in work:
            if only & set(names):
                args = [values[d] for d in deps]
                result = scan(names[0], args[0], args[1] if k is None else k) if kind == "scan" else make(*args)
                values |= dict(zip(names, result if isinstance(result, tuple) else (result,)))
        return values

    def finish(table: pa.Table, states: dict[str, tuple[bool, float]]) -> pa.Table:
        table = table.sort_by(ROW)
        values = values_of(table, inputs)
        b = table.column(BLOCK)[0].as_py()
        begin = 0 if b == 0 else int(np.searchsorted(values[ROW], lower(b)))

        def scan(name: str, x: np.ndarray, k: float | np.ndarray) -> np.ndarray:
            y = np.full(len(x), np.nan)
            y[begin:] = K.scan_on(x[begin:], k if isinstance(k, float) else k[begin:], *states.get(name, (False, np.nan)))
            return y

        values = through_steps(values, scan, made)
        return pa.Table.from_arrays([*(table.column(c) for c in through), *(pa.array(np.asarray(values[n], float), from_pandas=True) for n in new)], names=[*through, *new])

    if not scans:
        return rows.groupBy(*by).applyInArrow(lambda t: finish(t, {}), out)

    parts = [f"{f}{n}" for n in scans for f in ("scale", "end", "fresh", "some", "gaps")] + [f"on{n}{m}" for n, m in over]
    read = [d for d in inputs if any(d in deps for names, _, deps, *_ in work if leading & set(names))]

    def piece(table: pa.Table) -> pa.Table:
        """The map of a piece from the states before it to the states after it, in the order of ``parts``."""
        table = table.sort_by(ROW)
        values = values_of(table, read)
        cold = through_steps(values, lambda _, x, k: K.scan_on(x, k), leading)
        zero = through_steps(values, lambda _, x, k: K.scan_on(x, k, True, 0.0), leading)
        nothing = {n: v if n == ROW else np.zeros(len(v)) for n, v in zero.items()}
        ks = {names[0]: zero[deps[1]] if k is None else k for names, kind, deps, _, k in work if kind == "scan"}
        # What is left of a state of one: in its own scan, and in those over it.
        unit = {m: through_steps(nothing, lambda n, x, k, m=m: K.scan_on(nothing[m] if n == m else x, ks[n], True, float(n == m)), {m, *(s for n, o in over if o == m for s in upto[n])} & {s for s in leading if m in behind({s})}) for m in scans}
        found = [float(v) for n in scans for v in (unit[n][n][-1], zero[n][-1], cold[n][-1], np.isfinite(cold[n]).any(), not np.isfinite(zero[n]).all())]
        found += [float(unit[m][n][-1]) for n, m in over]
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1) for c in by), *(pa.array([v], pa.float64()) for v in found)], names=[*by, *parts])

    states = [f"{f}{n}" for n in scans for f in ("begun", "y")]

    def compose(table: pa.Table) -> pa.Table:
        """The states before each block of a series, one row per block."""
        table = table.sort_by(BLOCK)
        p = {name: _numbers(table, name).tolist() for name in parts}
        now, before = dict.fromkeys(scans, (False, float("nan"))), {n: [] for n in scans}
        for i in range(table.num_rows):
            for n in scans:
                before[n].append(now[n])
            more = {n: sum(p[f"on{n}{m}"][i] * now[m][1] for x, m in over if x == n) for n in scans}
            now = {n: K.scan_after(now[n], (p[f"scale{n}"][i], p[f"end{n}"][i] + (more[n] if now[n][0] else 0.0), p[f"fresh{n}"][i], bool(p[f"some{n}"][i]), bool(p[f"gaps{n}"][i]))) for n in scans}
        columns = [pa.array([float(s[j]) for s in before[n]], pa.float64()) for n in scans for j in (0, 1)]
        return pa.Table.from_arrays([*(table.column(c) for c in by), *columns], names=[*by, *states])

    own = [df.schema[c] for c in by]
    double = lambda names: [T.StructField(n, T.DoubleType()) for n in names]
    known = source.where(_piece(lower, size)[1]).select(*by, ROW, *(d for d in read if d not in by and d != ROW))
    begin = known.groupBy(*by).applyInArrow(piece, T.StructType([*own, *double(parts)])).groupBy(*keys).applyInArrow(compose, T.StructType([*own, *double(states)]))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in left.select(through).schema] + [pa.array([], pa.float64()) for _ in new], names=[*through, *new])
        return finish(left, {n: (bool(_numbers(right, f"begun{n}")[0]), float(_numbers(right, f"y{n}")[0])) for n in scans} if right.num_rows else {})

    return rows.groupBy(*by).cogroup(begin.groupBy(*by)).applyInArrow(both, out)


def _machines(plan: Plan, df: DataFrame, machines: list[Step]) -> DataFrame:
    """df with the lines of state machines: each series' rows in order, a batch at a time, the state carried on."""
    keys, work = plan.keys, [(s.names, s.deps, s.make) for s in machines]
    names = [n for s in machines for n in s.names]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, states = None, [None] * len(work)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = {d: _numbers(batch, d) for d in {d for _, deps, _ in work for d in deps}}
            made = {n: np.full(batch.num_rows, np.nan) for n in names}
            starts = [*np.flatnonzero(batch.column(ROW).to_numpy() == 0).tolist(), batch.num_rows]
            for a, b in zip([0, *starts] if starts[0] else starts, starts if starts[0] else starts[1:]):
                here = tuple(batch.column(k)[a].as_py() for k in keys)
                if series is None or here != series or batch.column(ROW)[a].as_py() == 0:
                    series, states = here, [None] * len(work)
                for i, (lines, deps, make) in enumerate(work):
                    got, states[i] = make(states[i], *(values[d][a:b] for d in deps))
                    for n, v in zip(lines, got):
                        made[n][a:b] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[n], from_pandas=True) for n in names)], names=[*batch.schema.names, *names])

    return df.repartition(*keys).sortWithinPartitions(*keys, ROW).mapInArrow(run, schema)
