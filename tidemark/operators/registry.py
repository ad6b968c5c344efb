"""Feeds: what an indicator is called, what it takes, which lines it has and how it is planned."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from ..plans.planner import Plan

OHLCV = ("open", "high", "low", "close", "volume")


class P(NamedTuple):
    """A parameter's default and bounds; an int default makes it integral."""

    default: float
    low: float
    high: float


@dataclass(frozen=True)
class Indicator:
    id: str
    group: str
    lines: tuple[str, ...]
    params: dict[str, P]
    requires: tuple[str, ...]
    kind: str  # W window, R linear recursion, S state machine
    build: Callable[..., tuple[str, ...] | str]
    phrases: tuple[str, ...]

    @property
    def feeds(self) -> tuple[str, ...]:
        """Addresses: the bare id is the first line."""
        return (self.id, *(f"{self.id}_{line.upper()}" for line in self.lines[1:]))


INDICATORS: dict[str, Indicator] = {}
#: feed id: (indicator id, line)
FEEDS: dict[str, tuple[str, str]] = {}


def indicator(id: str, group: str, kind: str, params: dict[str, P] | None = None, requires: tuple[str, ...] = ("close",), lines: tuple[str, ...] = ("line",), phrases: tuple[str, ...] = ()):
    """Register build(plan, **params), which returns the step of each line."""

    def register(build: Callable) -> Callable:
        spec = Indicator(id, group, tuple(lines), params or {}, tuple(requires), kind, build, tuple(phrases))
        if id in INDICATORS:
            raise ValueError(f"{id} is registered twice")
        INDICATORS[id] = spec
        FEEDS.update({feed: (id, line) for feed, line in zip(spec.feeds, spec.lines)})
        return build

    return register


def bind_params(spec: Indicator, given: dict | None = None) -> dict:
    """Parameters with defaults filled in; an unknown name, a wrong type or a value out of bounds raises."""
    given = dict(given or {})
    unknown = sorted(set(given) - set(spec.params))
    if unknown:
        raise ValueError(f"{spec.id} has no parameter {', '.join(unknown)}")
    out = {}
    for name, p in spec.params.items():
        value = given.get(name, p.default)
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise ValueError(f"{spec.id}: {name} must be a number")
        if isinstance(p.default, int):
            if value != int(value):
                raise ValueError(f"{spec.id}: {name} must be a whole number")
            value = int(value)
        else:
            value = float(value)
        if not p.low <= value <= p.high:
            raise ValueError(f"{spec.id}: {name}={value} is not within [{p.low}, {p.high}]")
        out[name] = value
    return out


def feed_ids() -> list[str]:
    return sorted(FEEDS)


def phrase_table() -> list[tuple[str, str]]:
    """(phrase, feed) rows, longest phrase first, then phrase, then feed.  Every line has its indicator's phrases."""
    rows = {(p, feed) for spec in INDICATORS.values() for feed in spec.feeds for p in spec.phrases}
    return sorted(rows, key=lambda r: (-len(r[0]), *r))


def plan_feed(plan: Plan, feed: str, params: dict | None = None, columns: tuple[str, ...] | None = None) -> str:
    """The step of one feed; raises for unknown feeds, parameters out of bounds and missing inputs."""
    if feed not in FEEDS:
        raise KeyError(f"unknown feed {feed}")
    id, line = FEEDS[feed]
    spec = INDICATORS[id]
    if columns is not None and (missing := [c for c in spec.requires if c not in columns]):
        raise ValueError(f"{id} needs {', '.join(missing)}")
    bound = bind_params(spec, params)
    steps = spec.build(plan, **bound)
    steps = (steps,) if isinstance(steps, str) else steps
    return steps[spec.lines.index(line)]


def with_feeds(df: DataFrame, feeds: list[str | tuple[str, dict]], keys: tuple[str, ...] = ("symbol",), order: str = "ts", keep: tuple[str, ...] | None = None, block: Column | str | None = None, rows: int = 65_536) -> DataFrame:
    """df with a double column for each feed, named by its lower-cased id.

    feeds: ids, or (id, parameters) pairs, or (id, parameters, column name) triples.  Rows of one series need distinct
    ``order`` values.  With ``block``, a column that does not fall as ``order`` rises (a day, say), series are spread over
    blocks of ``rows`` rows; without it a series is one group.
    """
    plan = Plan(keys, order, block, rows)
    outputs = {}
    for feed in feeds:
        id, params, name = (feed, None, None) if isinstance(feed, str) else (*feed, None)[:3]
        outputs[(name or id).lower()] = plan_feed(plan, id, params, tuple(df.columns))
    return plan.run(df, outputs, keep)
