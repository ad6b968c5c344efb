"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of the words in it, a document's is
the noisy-or of its sentences', and only documents have labels; the weights maximise the documents' likelihood.  The
sentences whose own probability is high are the offending ones.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import text_of, without

SENTENCE = re.compile(r"[^.!?\n\r]+")
TOKEN = re.compile(r"[^\W\d_]+")
#: Beginnings of words that are features beside the whole word.
STEMS = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has a word."""
    for m in SENTENCE.finditer(text):
        words = set(TOKEN.findall(m[0].lower()))
        if words:
            yield m.start(), m.end(), words


#: A sentence without any evidence is this unlikely (log odds) at most, so that a text isn't toxic for being long.
CALM = -12.0


def evidence(texts: list[str], labels: list[int], least: float) -> dict[str, int]:
    """Features that documents of label 1 have more often than chance: by the log-likelihood ratio of their counts.

    Only what three such documents share is kept at all, and the others are counted for that alone.
    """
    found: Counter = Counter()
    for text, y in zip(texts, labels):
        if y:
            found.update(features_of(text))
    found = Counter({f: a for f, a in found.items() if a >= 3})
    other: Counter = Counter()
    for text, y in zip(texts, labels):
        if not y:
            other.update(f for f in features_of(text) if f in found)
    share, kept = sum(labels) / len(labels), []
    for f, a in found.items():
        b = other[f]
        if a / (a + b) > share:
            gain = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
            if gain >= least:
                kept.append(f)
    return {f: i for i, f in enumerate(sorted(kept))}


def features_of(text: str) -> set[str]:
    return {f for _, _, words in sentences(text) for w in words for f in features(w)}


def fit(texts: list[str], labels: list[int], rounds: int = 300, least: float = 16.0, l2: float = 3e-5) -> dict[str, float]:
    """Weights by feature, the bias under ``""``; only features with evidence of at least ``least`` take part.

    Without both labels among the texts the weights are empty and the bias says which label there is.
    """
    positive = sum(labels)
    if not 0 < positive < len(labels):
        return {"": 6.0 if positive else CALM}
    index = evidence(texts, labels, least)
    feature, sentence, owner = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for _, _, words in sentences(text):
            own = {index[f] for w in words for f in features(w) if f in index}
            feature.extend(own)
            sentence.extend([len(owner)] * len(own))
            owner.append(d)
    feature, sentence, owner = np.array(feature, np.int32), np.array(sentence, np.int32), np.array(owner, np.int32)
    y, n, m = np.array(labels, float), len(labels), len(owner)
    # Each label weighs half in the loss.
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (n - positive))
    w, b = np.zeros(len(index)), CALM
    m1, m2, rate = np.zeros(len(index) + 1), np.zeros(len(index) + 1), 0.15
    for t in range(1, rounds + 1):
        z = b + np.bincount(sentence, w[feature], minlength=m)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-9)
        none = np.exp(np.clip(np.bincount(owner, np.log1p(-p), minlength=n), -700, -1e-12))
        # d log-likelihood / dz of a sentence: p q / (1 - q) in toxic documents, -p in the others.
        pull = weight[owner] * np.where(y[owner] == 1, p * (none / (1 - none))[owner], -p)
        grad = np.r_[np.bincount(feature, pull[sentence], minlength=len(index)) - l2 * w, pull.sum()]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-6)
        w, b = w + step[:-1], min(b + step[-1], CALM)
    return {"": float(b)} | {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}


def training_rows(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, most: dict[int, int], longest: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of a bounded sample of labelled documents: by hash order, at most most[label] ids of each label.

    Texts over ``longest`` characters are not learnt from (they are scored), which bounds what the driver gets.  Ids
    labelled twice count by their larger label, ids that two texts share by the smaller text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).alias("y")).where(allowed)
    order = F.md5(F.concat(F.lit("sample:"), F.col(id).cast("string")))
    chosen = None
    for y, n in most.items():
        part = known.where(F.col("y") == y).orderBy(order, id).limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(id, text_of(text).alias("t")).where(F.length("t") <= longest)
    # At most sum(most.values()) rows of two numbers: a proven bound.
    return texts.join(F.broadcast(chosen), id).groupBy(id).agg(F.min("t").alias("t"), F.max("y").alias("y"))


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", allowed: Column | None = None, most: dict[int, int] | None = None, longest: int = 20_000, id: str = "doc_id", text: str = "text") -> dict[str, float]:
    """Weights learnt on the driver from at most 2000 toxic and 4000 other labelled documents (``most``) that ``allowed`` lets in."""
    rows = training_rows(documents, labels, label, F.lit(True) if allowed is None else allowed, most or {1: 2000, 0: 4000}, longest, id, text).collect()
    rows.sort(key=lambda r: (r[id], r["t"]))
    return fit([r["t"] for r in rows], [int(r["y"]) for r in rows])


def score_text(text: str, weights: dict[str, float], cache: dict[str, float], cutoff: float) -> tuple[float, list[dict]]:
    """The document's probability, and its offending sentences; no sentence: 0."""
    bias, none, found = weights[""], 0.0, []
    for start, end, words in sentences(text):
        z = bias
        for word in words:
            own = cache.get(word)
            if own is None:
                if len(cache) > 400_000:
                    cache.clear()
                own = cache[word] = sum(weights.get(f, 0.0) for f in features(word))
            z += own
        none += max(z, 0.0) + np.log1p(np.exp(-abs(z)))  # -log(1 - p)
        if z >= cutoff:
            found.append({"start": start, "end": end, "score": float(1 / (1 + np.exp(-z)))})
    return float(-np.expm1(-none)), found


SENTENCES = "array<struct<start:int,end:int,score:double>>"


def score(df: DataFrame, weights: dict[str, float], text: str = "text", sentence_score: float = 0.5, out: tuple[str, str] = ("score", "offending"), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``out``: the score (0 to 1), and the code-point spans of the sentences that
    score sentence_score or more.

    A null or empty text, or one without letters, scores 0.  Columns with these names are replaced.
    weights: as from train(); a vocabulary bounded by the training sample, which is broadcast.
    """
    df = without(df, *out)
    keep = tuple(c for c in df.columns if keep is None or c in keep)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    cutoff = float(np.log(sentence_score / (1 - sentence_score)))
    spans = T._parse_datatype_string(SENTENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, text):
                both = [score_text(x or "", shared.value, cache, cutoff) for x in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([s for s, _ in both], pa.float64()), pa.array([f for _, f in both], kind)], names=[*keep, *out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out[0], T.DoubleType()), T.StructField(out[1], spans)]))
