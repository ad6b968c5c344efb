"""Secret scan in Spark expressions: patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused, without

#: kind: pattern, the group whose length counts, the least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What finds the same matches faster, where a failing match is only a shorter one of the same run.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"(?<![0-9a-f])[0-9a-f]{24,}"}
KINDS = (*BASE, "entropy")

#: Strings that can be secrets: runs of one alphabet with a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
WINDOW = 20
#: Character class of a candidate (the first that fits), and the bits a character that a window of it needs.
CLASSES = (("[0-9a-f]+|[0-9A-F]+", 2.8), ("[A-Z0-9]+", 3.4), (".*", 3.75))
#: Candidates that are no secrets: digits only, UUIDs, dates and times, paths of plain words, placeholders.
ALLOW = (
    r"[0-9]+", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*", r"(?:/?[a-z]+[0-9]{0,4}[/_-]){2,}+[a-z]*[0-9]{0,4}/?", r"(?i).*(?:example|placeholder|xxxx|0000000).*",
)
_ONE = 1 << 32


def _weight(count: int) -> int:
    """count * log2(count) in fixed point, so that sums don't drift."""
    return round(count * math.log2(count) * _ONE) if count else 0


def running_sums(a: Column) -> Column:
    """Sums of the first i elements of an int array, in blocks of its size's root (appending one by one is quadratic)."""
    empty = F.array().cast("array<int>")
    grow = lambda part: F.aggregate(part, empty, lambda acc, x: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x).cast("int"))))
    step = F.ceil(F.sqrt(F.size(a))).cast("int")
    local = F.transform(F.sequence(F.lit(0), F.size(a) - 1, step), lambda i: grow(F.slice(a, i + 1, step)))
    ends = F.transform(local, lambda p: F.element_at(p, -1))
    sums = F.zip_with(local, F.concat(F.array(F.lit(0)), grow(ends)), lambda p, o: F.transform(p, lambda x: x + o))
    return F.when(F.size(a) > 0, F.flatten(F.filter(sums, lambda p: p.isNotNull()))).otherwise(empty)


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match begins, from the pieces between matches and the matches."""
    before = F.concat(F.array(F.lit(0)), F.transform(matches, F.length))
    return F.zip_with(F.slice(gaps, 1, F.size(matches)), F.slice(before, 1, F.size(matches)), lambda g, m: F.length(g) + m)


def _accepted(starts: Column, matches: Column, secret: Column, kind: int, least: int) -> Column:
    """(start, kind, end) of the matches whose secret part is long enough."""
    every = F.arrays_zip(starts.alias("at"), F.transform(matches, F.length).alias("n"), F.transform(secret, F.length).alias("g"))
    span = lambda x: F.struct(x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + x["n"]).alias("end"))
    return F.transform(F.filter(every, lambda x: x["g"] >= least), span)


def _entropy(index: Column, bound: Column) -> Column:
    """(first, last): start of the first window whose entropy is enough and end of the last; first -1 if none is.

    index: the characters' numbers.  A step counts a character in and another out, and the sum of count * log2(count)
    follows from those two counts alone.  Counts are at most WINDOW + 1, so twelve of them are kept in one long.
    """
    table = F.array(*(F.lit(_weight(c)) for c in range(WINDOW + 2)))
    w = lambda c: F.get(table, c)
    each, bits = 12, 5
    shift = lambda c: F.pmod(c, F.lit(each)) * bits
    place = lambda c: F.call_function("div", c, F.lit(each))
    count = lambda n, c: F.call_function("shiftright", F.get(n, place(c)), shift(c)).bitwiseAND(31).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // each)).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, i: Column) -> Column:
        enters, leaves = F.coalesce(F.get(index, i), F.lit(-1)), F.when(i >= WINDOW, F.get(index, i - WINDOW)).otherwise(-1)
        hot = (i >= WINDOW) & (acc["s"] <= bound)  # the window that ended one before
        more = F.when(enters == leaves, F.lit(0)).otherwise(
            F.when(enters < 0, F.lit(0)).otherwise(w(count(acc["n"], enters) + 1) - w(count(acc["n"], enters)))
            + F.when(leaves < 0, F.lit(0)).otherwise(w(count(acc["n"], leaves) - 1) - w(count(acc["n"], leaves))))
        counts = F.transform(acc["n"], lambda c, j: c + F.when((enters >= 0) & (j == place(enters)), one(enters)).otherwise(0) - F.when((leaves >= 0) & (j == place(leaves)), one(leaves)).otherwise(0))
        return F.struct(counts.alias("n"), (acc["s"] + more).cast("long").alias("s"), F.when(hot & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"))

    return F.aggregate(F.sequence(F.lit(0), F.size(index)), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def find_secrets(df: DataFrame, text: str = "text", out: str = "spans", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Add ``out``: array of (kind, start, end) by start, then kind; offsets in code points, end exclusive.

    Kinds assign, access and hex are whole matches of their pattern (leftmost, not overlapping, failing ones dropped);
    ``entropy`` spans are added where a candidate string that no ``allow`` pattern matches as a whole has windows of
    enough entropy for its character class: from the first such window to the end of the last.  A null or empty text
    has no spans; repeated rows are scanned each; a column named like ``out`` is replaced.
    """
    df = without(df, out)
    kept = df.columns
    text_, cut_, all_ = (unused(df, x) for x in ("whole", "candidates", "found"))
    match, starts, sums = ({k: unused(df, f"{x}_{k}") for k in KINDS} for x in ("matches", "starts", "sums"))
    t = text_of(text)
    now = df.withColumn(text_, t)
    found = {}
    for k, (pattern, group, least) in BASE.items():
        use = FAST.get(k, pattern)
        now = now.withColumn(match[k], F.when(F.col(text_).rlike(use), F.regexp_extract_all(text_, F.lit(use), F.lit(0))))
        found[k] = (use, group, least)
    now = now.withColumn(match["entropy"], F.when(F.col(text_).rlike(CANDIDATE), F.regexp_extract_all(text_, F.lit(CANDIDATE), F.lit(0))))
    for k in KINDS:
        use = found[k][0] if k in found else CANDIDATE
        gaps = F.split(text_, use, -1)
        now = now.withColumn(starts[k], F.when(F.col(match[k]).isNotNull(), _starts(gaps, F.col(match[k]))))
    for k in KINDS:
        now = now.withColumn(sums[k], F.when(F.col(starts[k]).isNotNull(), running_sums(F.col(starts[k]))))
    parts = []
    for number, k in enumerate(BASE):
        use, group, least = found[k]
        secret = F.regexp_extract_all(text_, F.lit(use), F.lit(group)) if group else F.col(match[k])
        parts.append(F.when(F.col(match[k]).isNotNull(), _accepted(F.col(sums[k]), F.col(match[k]), secret, number, least)))
    fits = lambda c, p: c.rlike(rf"\A(?:{p})\z")
    allowed = lambda c: F.expr("false") if not allow else _any(fits(c, p) for p in allow)

    def bound(c: Column) -> Column:
        out = F.lit(0)
        for p, bits in reversed(CLASSES):
            out = F.when(fits(c, p), F.lit(math.floor(WINDOW * (math.log2(WINDOW) - bits) * _ONE))).otherwise(out)
        return out

    zipped = F.filter(F.arrays_zip(F.col(sums["entropy"]).alias("at"), F.col(match["entropy"]).alias("c")), lambda x: ~allowed(x["c"]))
    index = lambda c: F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    now = now.withColumn(cut_, F.when(F.col(match["entropy"]).isNotNull(), F.transform(zipped, lambda x: F.struct(x["at"].alias("at"), bound(x["c"]).alias("bound"), index(x["c"]).alias("index")))))
    hot = F.filter(F.transform(cut_, lambda x: F.struct(x["at"].alias("at"), _entropy(x["index"], x["bound"]).alias("e"))), lambda x: x["e"]["first"] >= 0)
    parts.append(F.when(F.size(cut_) > 0, F.transform(hot, lambda x: F.struct((x["at"] + x["e"]["first"]).alias("start"), F.lit(len(BASE)).alias("kind"), (x["at"] + x["e"]["last"]).alias("end")))))
    kind = "array<struct<start:int,kind:int,end:int>>"
    merged = F.sort_array(F.concat(*(F.coalesce(p.cast(kind), F.array().cast(kind)) for p in parts)))
    names = F.array(*map(F.lit, KINDS))
    return now.withColumn(all_, merged).select(*kept, F.transform(all_, lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias(out))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out
