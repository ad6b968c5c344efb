"""URL filter: all glob rules at once by a bit-parallel automaton.

A rule is a glob over the canonical URL ``.host``, byte 0xFF, ``path`` (UTF-8 has no 0xFF, so no rule for a host can
match inside a path).  Every literal byte or ``?`` of every rule is one bit of a multiword state; a step is shift, or
in the rules' first bits, keep the bits before a ``*``, and mask with the byte's table.  All URLs of a batch step
together, a column of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, without

#: The rules of the task: verdict, host, path; the host's subdomains count too, and paths that begin so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Where no rule fits: globs over ``.host`` + ``|`` + ``path`` that are blocked, anything else is allowed.
GLOBS = ("*.*casino*|*", "*.*cheap-pills*|*", "*.*ads-track*|*", "*.*adult-*|*", "*.*spam-*|*", "*.*free-bets*|*", "*|*/login*", "*|*.exe")
SEPARATOR = b"\xff"


@dataclass(frozen=True)
class Automaton:
    words: int
    always: np.ndarray  # first bits of rules that begin with *
    first: np.ndarray  # first bits of all rules
    keep: np.ndarray  # bits before a *
    table: np.ndarray  # (256, words)
    last: tuple[tuple[int, np.uint64, bool], ...]  # a rule's last bit, and whether a * follows


def build(globs: list[bytes]) -> Automaton:
    """The automaton of non-empty globs with at least one literal or ``?``: ``*`` is any run of bytes, ``?`` one byte."""
    size = sum(len(g.replace(b"*", b"")) for g in globs)
    words = max(1, -(-size // 64))
    always, first, keep, table = (np.zeros(words, np.uint64) for _ in range(3)), None, None, np.zeros((256, words), np.uint64)
    always, first, keep = always
    last, at = [], 0
    for glob in globs:
        begin = at
        if not glob.replace(b"*", b""):
            raise ValueError("a glob needs more than *")
        for i, byte in enumerate(glob):
            if byte == 0x2A:
                if at > begin:
                    keep[(at - 1) // 64] |= np.uint64(1 << ((at - 1) % 64))
                continue
            bit = np.uint64(1 << (at % 64))
            table[:, at // 64] |= bit if byte == 0x3F else np.uint64(0)
            table[byte, at // 64] |= bit
            at += 1
        bit = np.uint64(1 << (begin % 64))
        first[begin // 64] |= bit
        if glob[:1] == b"*":
            always[begin // 64] |= bit
        last.append(((at - 1) // 64, np.uint64(1 << ((at - 1) % 64)), glob[-1:] == b"*"))
    return Automaton(words, always, first, keep, table, tuple(last))


def matches(texts: list[bytes], auto: Automaton) -> np.ndarray:
    """(texts, rules): whether each rule matches the whole text."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")  # the long ones first: the texts that still have bytes are a prefix
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    state = np.zeros((n, auto.words), np.uint64)
    begin, sizes = begin[order], size[order]
    alive = n
    for j in range(int(size.max()) if n else 0):
        while alive and sizes[alive - 1] <= j:
            alive -= 1
        now = state[:alive]
        step = now << np.uint64(1)
        if auto.words > 1:
            step[:, 1:] |= now[:, :-1] >> np.uint64(63)
        # A shift out of a rule's last bit lands on the next rule's first bit: it doesn't count there.
        step &= ~auto.first
        step |= auto.first if j == 0 else auto.always
        state[:alive] = (step & auto.table[data[begin[:alive] + j]]) | (now & auto.keep)
    out = np.zeros((n, len(auto.last)), bool)
    for r, (word, bit, _) in enumerate(auto.last):
        out[order, r] = (state[:, word] & bit) != 0
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_globs(rules=RULES, globs=GLOBS) -> list[bytes]:
    return [b"*." + host.encode() + SEPARATOR + path.encode() + b"*" for _, host, path in rules] + [g.encode().replace(b"|", SEPARATOR) for g in globs]


def judge(df: DataFrame, url: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (host and path of the longest rule that fits, else null), ``glob`` and ``verdict``.

    verdict is the rule's, or without one ``block`` where a glob of the block list matches, else ``allow``.  ``glob`` is
    the first such glob, where no rule fits.  Null urls and those without ``://`` have an empty host and path.  Columns
    of these names are replaced; repeated rows are judged each.
    """
    df = without(df, "host", "path", "rule", "glob", "verdict")
    ranked = sorted(rules, key=lambda r: -len((r[1] + r[2]).encode()))
    patterns = rule_globs(ranked, globs)

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        auto = build(patterns)
        for hosts, paths in parts:
            hit = matches([b"." + h.encode() + SEPARATOR + p.encode() for h, p in zip(hosts, paths)], auto)
            yield pd.Series(np.where(hit.any(axis=1), hit.argmax(axis=1), -1)).astype("int32")

    def judged(hosts: Column, paths: Column) -> Column:
        return F.pandas_udf(run, "int")(hosts, paths)

    names = F.array(*(F.lit(h + p) for _, h, p in ranked), *(F.lit(g) for g in globs))
    verdicts = F.array(*(F.lit(v) for v, _, _ in ranked), *(F.lit("block") for _ in globs))
    hit = unused(df, "hit")
    found = df.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))).withColumn(hit, judged(F.col("host"), F.col("path")))
    own = F.col(hit).between(0, len(ranked) - 1)
    return found.select("*", F.when(own, F.get(names, F.col(hit))).alias("rule"), F.when(F.col(hit) >= len(ranked), F.get(names, F.col(hit))).alias("glob"), F.when(F.col(hit) >= 0, F.get(verdicts, F.col(hit))).otherwise("allow").alias("verdict")).drop(hit)
