"""Input columns of any name come back as they went in; queries against brute force that no other test holds."""

import hashlib
import math
import re
from pathlib import Path

import numpy as np
import pytest
from data import SF
from pyspark.sql import functions as F
from test_native import brute_spans
from tidemark.llm import bpe, langid, pii, queries, secrets, syncmers, toxicity, urlfilter

LLM = Path(queries.__file__).parent
LONG = "word " * 9000
TEXTS = ["card 4111 1111 1111 1111, mail jo@example.com", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', LONG, None, ""]


def names_in(module) -> list[str]:
    """Every name that the module's source quotes, and their usual forms."""
    quoted = set(re.findall(r'"(_{0,2}[A-Za-z][A-Za-z0-9_]*)"', Path(module.__file__).read_text()))
    forms = quoted | {f"_{q.lstrip('_')}" for q in quoted} | {f"_{x}" for x in "abcdefghijklmnopqrstuvwxyz"} | {f"{x}_{k}" for x in ("_m", "_s", "_a", "matches", "starts", "sums") for k in secrets.KINDS}
    seen, out = set(), []
    for f in sorted(forms):
        if f.lower() not in seen:
            seen.add(f.lower())
            out.append(f)
    return out


@pytest.mark.parametrize(
    "module,run,made",
    [
        (pii, lambda d: pii.pseudonymise(d, "k"), {"n_replaced"}),
        (secrets, lambda d: secrets.find_secrets(d), {"spans"}),
        (bpe, lambda d: bpe.encode(d, *queries.vocabulary()), {"ids"}),
        (syncmers, lambda d: syncmers.add_anchors(d, "text", "anchors_out"), {"anchors_out"}),
        (urlfilter, lambda d: urlfilter.judge(d, "text"), {"host", "path", "rule", "glob", "verdict"}),
        (toxicity, lambda d: toxicity.score(d, {"": -3.0, "word": 1.0}), {"score", "offending"}),
        (langid, lambda d: langid.predict(d, {"en": ["e", "t"]}), {"lang_pred", "score", "margin"}),
    ],
    ids=["pii", "secrets", "bpe", "syncmers", "urls", "toxicity", "langid"],
)
def test_columns_come_back(spark, module, run, made):
    extra = [n for n in names_in(module) if n.lower() not in {"doc_id", "text", *made}]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("*", *(F.concat(F.lit(f"{n}="), F.col("doc_id").cast("string")).alias(n) for n in extra))
    out = run(df)
    assert [c for c in df.columns if c not in out.columns] == []
    got = out.collect()
    assert len(got) == len(TEXTS)
    for r in got:
        wrong = [n for n in extra if r[n] != f"{n}={r.doc_id}"]
        assert not wrong, wrong
        assert module is pii or r.text == TEXTS[r.doc_id]


def test_one_very_long_candidate(spark):
    """Half a million characters of one string, its windows by definition at the ends and its span by counting."""
    import random
    import time

    random.seed(2)
    text = "x1 " + "".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=500_000))
    began = time.time()
    [r] = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    spans = [(s.start, s.end, s.kind) for s in r.spans if s.kind == "entropy"]
    assert spans == [(a, b, k) for a, b, k in brute_spans(text) if k == "entropy"] and time.time() - began < 60


def test_secrets_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_secrets(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute_spans(texts[r.doc_id] or "")
        say = lambda some: ",".join(f"{k}:{a}:{b}" for a, b, k in some)
        assert [r[f"n_{k}"] for k in secrets.KINDS] == [sum(s[2] == k for s in spans) for k in secrets.KINDS]
        assert r.spans == say(spans) and r.base_sha256 == hashlib.sha256(say(s for s in spans if s[2] != "entropy").encode()).hexdigest()


def test_toxicity_query_by_definition(spark):
    """Scores of all documents by the plain noisy-or of the weights that the query's training gives."""
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    weights = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "toxic", ~held)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op6_toxicity(spark, SF).collect():
        clean = 1.0
        for _, _, words in toxicity.sentences(texts[r.doc_id]):
            z = weights[""] + sum(weights.get(f, 0.0) for w in words for f in toxicity.features(w))
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(r.score - (1 - clean)) < 1e-9 and r.predicted == int(r.score >= 0.7)


def test_toxicity_gradient():
    """One step of the training climbs the likelihood of the noisy-or as its numerical gradient does."""
    texts = ["vile rot here. calm day.", "vile words again. good sun.", "calm day. good sun.", "good rot day. calm sun."] * 6
    labels = [1, 1, 0, 0] * 6

    def loss(weights: dict[str, float]) -> float:
        total = 0.0
        for t, y in zip(texts, labels):
            clean = 1.0
            for _, _, words in toxicity.sentences(t):
                z = weights[""] + sum(weights.get(f, 0.0) for f in {f for w in words for f in toxicity.features(w)})
                clean *= 1 - 1 / (1 + math.exp(-z))
            total += 0.5 / 12 * math.log(1 - clean if y else clean)
        return total

    early, late = (toxicity.fit(texts, labels, rounds=n, least=1.0, l2=0.0) for n in (1, 40))
    start = {"": toxicity.CALM} | dict.fromkeys(toxicity.evidence(texts, labels, 1.0), 0.0)
    for f in start:
        if f:
            up = (loss(start | {f: 1e-5}) - loss(start | {f: -1e-5})) / 2e-5
            assert np.sign(early.get(f, 0.0)) == np.sign(round(up, 9)), (f, up)
    assert loss(start) < loss(start | early) < loss(start | late)
