"""Language identification by rank-order profiles.

A language's profile is the ranking of the n-grams (1 to 5 letters, word by word) of training documents by how often
they occur; a document is ranked in the same way, and the language whose profile its ranking is least out of place with
is predicted.  Profiles are learnt from a bounded sample; every document is judged by all of its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import text_of, unused, without

#: A word: a run of letters with their marks, in lower case; a run of over 48 is taken as several words.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,47}")
#: Longest n-gram, ranks in a profile, and words of a long text that are counted at a time.
LONGEST, RANKS, AT_ONCE = 5, 400, 100_000
UNKNOWN = "und"
#: n-grams are told apart, and ties ranked, by a sum of code points times these, modulo 2^64.
FACTORS = np.random.default_rng(11).integers(1, 2**64, (LONGEST + 1, LONGEST), np.uint64) | np.uint64(1)


def grams(word: str) -> list[str]:
    """All n-grams of a word with a space on either side, the space alone left out; repeats included."""
    padded = f" {word} "
    return [*word, *(padded[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(padded) - n + 1))]


def code(gram: str) -> int:
    return sum(ord(c) * int(f) for c, f in zip(gram, FACTORS[len(gram)])) % 2**64


def gram_counts(texts: list[str]) -> Counter:
    """How often each n-gram is in texts."""
    found, total = Counter(w for t in texts for w in WORD.findall(t.lower())), Counter()
    for word, n in found.items():
        for g in grams(word):
            total[g] += n
    return total


def codes(words: list[str]) -> np.ndarray:
    """The codes of all n-grams of the words: windows over the words between spaces that have none inside."""
    x = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = x == 32
    found = [x[~space] * FACTORS[1][0]]
    for n in range(2, LONGEST + 1):
        last = len(x) - n + 1
        if last < 1:
            break
        sums, inside = x[:last] * FACTORS[n][0], np.zeros(last, bool)
        for j in range(1, n):
            sums += x[j : j + last] * FACTORS[n][j]
            if j < n - 1:
                inside |= space[j : j + last]
        if n == 2:
            inside = space[:last] & space[1 : 1 + last]
        found.append(sums[~inside])
    return np.concatenate(found)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and how often each is there; a long text some words at a time."""
    known, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    for part in batched((m.group() for m in WORD.finditer(text)), AT_ONCE) if len(text) > 8 * AT_ONCE else [WORD.findall(text)]:
        if part:
            x = np.sort(codes(list(part)))
            edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            distinct, n = x[edge], np.diff(np.r_[edge, len(x)])
            if len(known):
                distinct, at = np.unique(np.concatenate([known, distinct]), return_inverse=True)
                n = np.bincount(at, np.concatenate([times, n])).astype(np.int64)
            known, times = distinct, n
    return known, times


def training_rows(docs: DataFrame, allowed: Column, most: int, languages: int, longest: int, id: str, text: str, lang: str) -> DataFrame:
    """(lang, t): at most ``most`` texts of each of the ``languages`` languages with the most rows, by the hash of the id.

    The hash is cut at a share that lets through about twice as many as are needed, while the texts are read, so only
    those are shuffled.  Texts of over ``longest`` characters are not learnt from.
    """
    known = docs.where(allowed & F.col(lang).isNotNull() & F.col(text).isNotNull())
    # At most ``languages`` rows of a name and a number: a proven bound.
    sizes = known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    texts = known.select(F.col(lang).alias("lang"), F.col(text).alias("t"), place.alias("h"), F.col(id).alias("id"))
    some = texts.join(F.broadcast(sizes), F.col("lang") == F.col("l")).where((F.col("h") < (2.0 * most + 50) / F.col("n")) & (F.length("t") <= longest))
    order = Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("t"))
    return some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("lang", "t", "k")


def train(docs: DataFrame, allowed: Column | None = None, most: int = 300, languages: int = 300, longest: int = 20_000, ranks: int = RANKS, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Profiles: for each language its ``ranks`` most frequent n-grams, ties by code points.

    Learnt from at most ``most`` documents of at most ``longest`` characters for each of at most ``languages`` languages
    (those with the most rows), of rows that ``allowed`` lets in and whose language and text are not null.  A language
    whose sample holds no letter has no profile.  n-grams are counted where the texts are; the driver gets the profiles.
    """
    rows = training_rows(docs, F.lit(True) if allowed is None else allowed, most, languages, longest, id, text, lang)

    def count(part: pa.Table) -> pa.Table:
        c = gram_counts(part.column("t").to_pylist())
        return pa.table({"lang": pa.array([part.column("lang")[0].as_py()] * len(c), pa.string()), "gram": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    # A sixteenth of a language's sample at a time.
    parts = rows.withColumn("part", F.col("k") % 16).groupBy("lang", "part").applyInArrow(count, "lang string, gram string, n long")
    found = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= ranks)
    profiles: dict[str, list[str]] = {}
    for r in sorted(best.select("lang", "gram", "k").collect(), key=lambda r: (r["lang"], r["k"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def distances(text: str, profiles: dict[str, list[str]], ranks: int = RANKS) -> tuple[int, dict[str, int]]:
    """How many n-grams of the text are ranked, and each language's out-of-place distance: the plain definition.

    The document's ``ranks`` most frequent n-grams are ranked, ties by code.  One that a profile has at another rank
    counts the difference, one that it does not have counts ``ranks``.
    """
    own = [g for g, _ in sorted(gram_counts([text]).items(), key=lambda x: (-x[1], code(x[0])))[:ranks]]
    places = {name: {g: i for i, g in enumerate(p)} for name, p in profiles.items()}
    return len(own), {name: sum(abs(i - at[g]) if g in at else ranks for i, g in enumerate(own)) for name, at in places.items()}


class Judge:
    """The same distances by arrays."""

    def __init__(self, profiles: dict[str, list[str]], ranks: int):
        self.names, self.ranks = sorted(profiles), ranks
        self.known = np.array(sorted({code(g) for p in profiles.values() for g in p}), np.uint64)
        # Where a profile does not have an n-gram, a rank so far off that its difference is cut to ``ranks``.
        self.places = np.full((len(self.known), len(self.names)), 1 << 30, np.int64)
        for j, name in enumerate(self.names):
            own = np.array([code(g) for g in profiles[name]], np.uint64)
            self.places[np.searchsorted(self.known, own), j] = np.arange(len(own))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): 1 less the least distance, and the second least less the least, as shares of the largest."""
        distinct, times = counted((text or "").lower())
        if not len(distinct) or not self.names:
            return UNKNOWN, 0.0, 0.0
        top = distinct[np.argsort(-times, kind="stable")[: self.ranks]]
        at = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
        rank = np.flatnonzero(self.known[at] == top)
        off = np.minimum(np.abs(self.places[at[rank]] - rank[:, None]), self.ranks).sum(axis=0) + self.ranks * (len(top) - len(rank))
        best = np.argsort(off, kind="stable")
        whole = float(self.ranks * len(top))
        second = off[best[1]] if len(off) > 1 else whole
        return self.names[best[0]], float(1 - off[best[0]] / whole), float((second - off[best[0]]) / whole)


def predict(df: DataFrame, profiles: dict[str, list[str]], text: str = "text", ranks: int = RANKS, out: tuple[str, str, str] = ("lang_pred", "score", "margin"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``out``: the language, its score and its lead over the second (0 to 1).

    A null text, one without a letter, and any text when nothing was learnt is ``und`` with score 0.  Equal distances go
    to the smaller name; repeated rows get equal results; columns named like ``out`` are replaced.  ``profiles``: at
    most 300 languages of 400 n-grams as from train(), which are broadcast.
    """
    df = without(df, *out)
    keep = tuple(c for c in df.columns if keep is None or c in keep)
    shared = df.sparkSession.sparkContext.broadcast(profiles)
    source = unused(df, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, ranks)
        for batch in batches:
            for part in slices(batch, source):
                got = [judge(t) for t in part.column(source).to_pylist()]
                made = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *out])

    fields = [T.StructField(out[0], T.StringType()), *(T.StructField(c, T.DoubleType()) for c in out[1:])]
    return df.select(*(F.col(f"`{c}`") for c in keep), text_of(text).alias(source)).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *fields]))
