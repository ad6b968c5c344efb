import re

import corpus_pipeline as P
from data import SF
from tidemark.llm import bpe, queries


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, seen = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns
        seen.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    (_, a, b), (_, _, c), (_, _, d), (_, _, e) = seen
    assert set(b.doc_id) < set(a.doc_id) and set(c.doc_id) < set(b.doc_id) and set(d.doc_id) == set(c.doc_id) and set(e.doc_id) <= set(d.doc_id)
    assert c.doc_id.is_unique and e.groupby("doc_id").size().max() == 2
    assert dict(zip(b.doc_id, b.text)).items() <= dict(zip(a.doc_id, a.text)).items()
    assert not c.text.fillna("").duplicated().any()
    mail = re.compile(r"\S+@\S+\.\S+")
    before, after = dict(zip(c.doc_id, c.text)), dict(zip(d.doc_id, d.text))
    changed = [i for i in before if before[i] != after[i]]
    assert changed and not any(set(mail.findall(before[i])) & set(mail.findall(after[i])) for i in before)
    assert all(d.set_index("doc_id").n_chars[i] == len(after[i]) for i in changed)
    last = P.STAGES[-1][1](spark, docs, SF).toPandas()
    enc = bpe.encoder(*queries.vocabulary())
    texts = dict(zip(e.doc_id, e.text))
    assert len(last) == len(e) and all(list(r.ids) == enc.encode_ordinary(texts[r.doc_id]) for r in last.itertuples())


def test_run(spark):
    got = P.run(spark, SF)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids"] and got.count() > 50


EXTRA = ("score", "copies", "size", "id", "sig", "m", "n_replaced", "ids", "component_id", "_size", "offending")


def awkward(spark):
    """Documents with a null in every column, empty and very long texts, ties, repeated rows, and clashing extra columns."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(30_000))
    base = [(1, "Ann ann.lee@mail.example.com wrote this one line of text for all", "en", "a", 65), (2, None, "en", "a", 0), (3, "", None, None, None), (4, long, "de", "b", len(long)), (None, "no id here", "en", "b", 10), (5, " \t\n", "en", "a", 3), (6, "one", "en", None, 3), (6, "one", "en", "b", 3), (6, "another text of this id", "en", "a", 23)]
    rows = [(*r, *("old",) * len(EXTRA)) for r in [*base, base[0], base[3], base[4]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        got = after.collect()
        assert all(r[c] == "old" for r in got for c in EXTRA), name
        ids = {r.doc_id for r in got}
        if name == "toxicity":
            assert len(got) == docs.count()
        if name == "near copies":  # texts without words are copies of each other, all rows of one id are one document
            assert ids == {1, 2, 4, 6, None} and len(got) == 1 + 1 + 1 + 3 + 2
        if name == "personal data":
            assert len(got) == docs.count() and not any("ann.lee" in (r.text or "") for r in got)
        if name == "mix":
            assert {r.doc_id for r in got if (r.text or "").split()} <= ids and len(got) <= 2 * docs.count()
    tokens = P.STAGES[-1][1](spark, docs, SF).collect()
    enc = bpe.encoder(*queries.vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id != 6}
    assert len(tokens) == docs.count() and all(r.ids == enc.encode_ordinary(texts[r.doc_id] or "") for r in tokens if r.doc_id != 6)


def test_stages_on_an_empty_table(spark):
    docs = awkward(spark).limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_mix_tells_rows_of_one_id_apart(spark):
    """Each row is taken as often as the operator says for its own source and size."""
    docs = awkward(spark)
    want = {(r.doc_id, r.source, r.size): r.copies for r in P.mixing.mix(docs).collect()}
    got = P.mix_sources(spark, docs, SF).groupBy("doc_id", "source", P.count_words(P.text_of()).alias("words")).count().collect()
    there = docs.groupBy("doc_id", "source", P.count_words(P.text_of()).alias("words")).count().collect()
    rows = {(r[0], r[1], r[2]): r[3] for r in there}
    assert {(r[0], r[1], r[2]): r[3] for r in got} == {k: rows[k] * n for k, n in want.items() if n}
