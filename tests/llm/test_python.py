"""Tokens, toxicity, near copies, neighbours, fingerprints and URLs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from data import SF
from pyspark.sql import functions as F
from tidemark.llm import ann, bpe, queries, simhash, syncmers, toxicity, urlfilter


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- byte-level BPE


def test_tokens(spark, documents, empty):
    ranks, pattern = queries.vocabulary()
    enc = bpe.encoder(ranks, pattern)
    out = bpe.decode(bpe.encode(documents, ranks, pattern), ranks).collect()
    assert len(out) == documents.count()
    for r in out:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, ranks, pattern).count() == 0
    with pytest.raises(Exception, match="vocabulary does not have"):
        bpe.decode(spark.createDataFrame([([50256],)], "ids array<int>"), ranks).collect()


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (64, 6), (200, 50)])
def test_chunks_make_no_difference(spark, chunk, overlap):
    """Texts cut into chunks of any size, endless runs and repeated rows included, give the ids of the whole texts."""
    ranks, pattern = queries.vocabulary()
    enc = bpe.encoder(ranks, pattern)
    random.seed(chunk)
    parts = ["don't ", "we'll", "  ", "\n\n", " \t x", "12345 ", "...!? ", "日本", "é" * 30, "a" * 90, " " * 45, "\u00a0b", "'s", "'re'", "word ", "\r\n", "😀", "\x00"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 60))) for _ in range(200)] + ["word " * 1000, "a" * 5000, " " * 3000, "x" * 400 + " word" * 300, None, ""]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*texts, texts[0], texts[200]])], "doc_id long, text string, ids string")
    got = bpe.encode(df, ranks, pattern, chunk=chunk, overlap=overlap).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text or ""), r.text
    only = bpe.encode(df, ranks, pattern, keep=("doc_id",), chunk=chunk, overlap=overlap)
    assert only.columns == ["doc_id", "ids"] and only.count() == len(got)
    cut = bpe.pieces(spark.createDataFrame([("h", "word " * 1000)], "_text string, _t string"), pattern, chunk, max(overlap, 12))
    assert cut.count() >= 5000 // chunk - 2


def test_bpe_query(spark):
    ranks, pattern = queries.vocabulary()
    enc = bpe.encoder(ranks, pattern)
    texts = dict(rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"))
    for i, n, ids, back in rows(queries.op5_bpe(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"):
        want = enc.encode_ordinary(texts[i] or "")
        assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and back == hashlib.sha256((texts[i] or "").encode()).hexdigest()


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    got = {i: (h, s, p) for i, h, s, p in rows(queries.op6_toxicity(spark, sf), "doc_id", "held_out", "score", "predicted")}
    truth = dict(rows(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "toxic"))
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= s <= 1 and p == int(s >= 0.7) for i, (h, s, p) in got.items())
    held = [(got[i][2], y) for i, y in truth.items() if i in got and got[i][0]]
    hit, wrong = sum(p and y for p, y in held), sum(p and not y for p, y in held)
    assert hit / sum(y for _, y in held) > 0.8 and wrong / len(held) < 0.02  # some labels are wrong


def test_toxicity_locates_sentences(spark, documents, empty):
    random.seed(2)
    plain = lambda: " ".join(f"word{chr(97 + random.randrange(26))}" for _ in range(6))
    texts = [f"{plain()}. {plain()}" for _ in range(60)] + [f"{plain()}. {plain()} scum {plain()}. {plain()}" for _ in range(60)]
    weights = toxicity.fit(texts, [0] * 60 + [1] * 60)
    df = spark.createDataFrame([(1, "all fine. utter SCUM he said. ok"), (2, "x. " * 3000), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, weights).collect()}
    (span,) = got[1].offending
    assert got[1].text[span.start : span.end].strip() == "utter SCUM he said" and got[1].score > 0.7 and got[2].score < 0.1 and got[3].score == 0
    assert toxicity.score(documents, weights).count() == documents.count() and toxicity.score(empty, weights).count() == 0


def test_toxicity_without_both_labels(spark, empty):
    assert toxicity.fit([], []) == {"": toxicity.CALM}
    assert toxicity.fit(["a"], [1]) == {"": 6.0}
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, toxic int")
    assert toxicity.train(empty, labels) == {"": toxicity.CALM}


def test_toxicity_sample_is_bounded(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).union(docs.select("doc_id", F.lit(0)))
    got = toxicity.training_rows(docs, labels, "toxic", F.lit(True), {1: 20, 0: 30}, 100).collect()
    assert sum(r.y for r in got) == 20 and len(got) == 50 and all(r.doc_id % 2 == r.y for r in got)


# --- SimHash


def slow_print(text: str, width: int) -> int:
    w = text.encode().lower().split()
    parts = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    n = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(parts))


def groups(points: dict[int, int], budget: int) -> dict[int, int]:
    root = {i: i for i in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(points)
    for a in ids:
        for b in ids:
            if a < b and (points[a] ^ points[b]).bit_count() <= budget:
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


def test_simhash_query(spark):
    texts = dict(rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"))
    prints = {i: slow_print(t or "", 3) for i, t in texts.items()}
    got = rows(queries.op7_simhash(spark, SF), "doc_id", "fingerprint", "component_id")
    want = groups(prints, 2)
    assert sorted(got) == sorted((i, f"{p:016x}", want[i]) for i, p in prints.items())


@pytest.mark.parametrize("budget", [1, 2, 3])
def test_trie_finds_every_link(spark, budget):
    random.seed(budget)
    base = [random.getrandbits(64) for _ in range(30)]
    prints = set(base) | {0, 1, 2**64 - 1}
    for b in base:
        for _ in range(12):
            for _ in range(random.randint(0, budget + 1)):
                b ^= 1 << random.randrange(64)
            prints.add(b)
    points = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(0, i, p - 2**64 if p >= 2**63 else p) for i, p in points.items()], "k int, id long, fp long")
    roots = dict(rows(simhash.components(simhash.near_links(df, budget)), "node", "root"))
    assert {i: roots.get(i, i) for i in points} == groups(points, budget)


def test_trie_pairs_with_little_memory(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 16)
    rng = np.random.default_rng(0)
    words = np.unique(rng.integers(0, 2**10, 300, dtype=np.uint64) | (rng.integers(0, 3, 300, dtype=np.uint64) << np.uint64(60)))
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(words, 4, 2) for i, j in zip(np.minimum(a, b), np.maximum(a, b))}
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if words[i] >> np.uint64(60) == words[j] >> np.uint64(60) and int(words[i] ^ words[j]).bit_count() <= 2}
    assert got == want


def test_long_chain_is_one_component(spark):
    links = spark.range(400).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    assert {r for _, r in rows(simhash.components(links), "node", "root")} == {0}


def test_simhash_edges(spark, documents, empty):
    got = rows(simhash.near_groups(documents), "doc_id", "component_id")
    assert len(got) == documents.count()
    assert {c for i, c in got if i in (1, 2)} == {1} and {c for i, c in got if i in (3, 4, 5)} == {3}
    assert simhash.near_groups(empty).count() == 0
    kept = rows(simhash.keep_one(documents), "doc_id")
    assert sorted(kept, key=str) == sorted([(1,), (3,), (6,), (7,), (8,), (9,), (10,), (None,)], key=str)


def test_several_prints_find_near_copies(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(3000)]
    docs, pairs = [], 150
    for i in range(pairs):
        w = random.choices(words, k=300)
        docs.append((2 * i, " ".join(w)))
        for _ in range(5):
            w[random.randrange(300)] = random.choice(words)
        docs.append((2 * i + 1, " ".join(w)))
    got = rows(simhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), width=1, prints=6, distinct=True, max_distance=3), "doc_id", "component_id")
    assert all(c in (i, i - 1) for i, c in got) and sum(c == i - 1 for i, c in got) > 0.9 * pairs


# --- nearest neighbours


def vectors(spark, pairs):
    return spark.createDataFrame(pairs, "vec_id long, embedding array<float>")


def brute(pairs, queries_, k):
    ok = {i: np.array(v, float) for i, v in pairs if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in queries_:
        near = sorted(((-float(ok[q] @ v / (np.linalg.norm(ok[q]) * np.linalg.norm(v))), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def test_ann_recall(spark):
    data = rows(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding")
    got = rows(queries.op8_ann(spark, SF), "query_id", "rank", "vec_id", "score")
    want = brute(data, [i for i, _ in data if i % 50 == 0], 5)
    assert len(got) == len(want) and len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    score = {(q, i): s for q, _, i, s in brute(data, [i for i, _ in data if i % 50 == 0], len(data))}
    assert all(abs(s - score[q, i]) < 1e-9 for q, _, i, s in got)


def test_ann_edges(spark):
    pairs = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (9, [float("inf"), 0.0])]
    got = rows(ann.search(vectors(spark, pairs), F.col("vec_id").isin(0, 3, 8)), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.search(vectors(spark, []), F.lit(True)).count() == 0


def test_ann_scales_and_clashing_names(spark):
    """Components near the ends of double precision, and input columns named like the operator's own."""
    pairs = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-201]), (4, [-1e300, 1e-300]), (5, [5e-324, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in pairs], "vec_id long, embedding array<double>, query string, v int, id int, keys string")
    got = rows(ann.search(df, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score")
    assert [(r, i) for _, r, i, _ in sorted(got)] == [(1, 5), (2, 3), (3, 1), (4, 2), (5, 4)]
    assert [s for *_, s in sorted(got)] == pytest.approx([1.0, 1 / 1.01**0.5, 0.5**0.5, 0.5**0.5, -1.0], abs=1e-15)


def test_ann_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8)
    pairs = [(i, [float(x) for x in (hot + 1e-3 * rng.normal(size=8) if i % 2 else rng.normal(size=8))]) for i in range(200)]
    wide = ann.Plan(8, 6, 3.0, 400, 2, 7)
    got = rows(ann.search(vectors(spark, pairs), F.col("vec_id") % 5 == 0, plan=wide), "query_id", "rank", "vec_id")
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in pairs]
    want = [t[:3] for t in brute(exact, range(0, 200, 5), 5)]
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.95 * len(want)


def test_probes_come_by_score():
    rng = np.random.default_rng(4)
    for m in (3, 6, 12):
        cell, inside = np.arange(m) * 10, rng.uniform(size=m)
        probes = ann.probes_of(cell, inside, 60)
        moves = probes - cell
        cost = [sum((inside[j] if d < 0 else 1 - inside[j]) ** 2 for j, d in enumerate(row) if d) for row in moves]
        assert cost == sorted(cost) and len({tuple(p) for p in probes}) == len(probes) and (np.abs(moves) <= 1).all()
        assert len(probes) == (27 if m == 3 else 61) and np.abs(moves[1]).sum() == 1
        from itertools import product

        best = sorted(sum((inside[j] if d < 0 else 1 - inside[j]) ** 2 for j, d in enumerate(row) if d) for row in product((-1, 0, 1), repeat=m)) if m < 12 else cost
        assert cost[:30] == pytest.approx(best[: len(cost)][:30], rel=0.25, abs=0.05)


# --- syncmers


def slow_anchors(text: str) -> list[tuple[int, int]]:
    """(pos, hash) of the closed syncmers; one anchor of all tokens for a text that has none."""
    import re

    h64 = lambda *ps: signed(chain(ps))
    words = re.findall(rf"[^\x20\x09-\x0D]{{1,{syncmers.TOKEN}}}", text, re.S)
    if not words:
        return []
    h = [h64(a, b) for a, b in zip(words, words[1:])]
    out = [(i, h64(h[i], h[i + 2], h[i + 3])) for i in range(len(h) - 3) if min(h[i : i + 4]) in (h[i], h[i + 3])]
    return out or [(0, h64(" ".join(words)))]


def slow_likeness(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    x, y = ({h: p for p, h in reversed(t)} for t in (a, b))
    if not x and not y:
        return 1.0
    met = sorted((p, y[h] - p) for h, p in x.items() if h in y)
    good = [i for i, (_, s) in enumerate(met) if len(met) == 1 or any(0 <= j < len(met) and abs(met[j][1] - s) <= syncmers.SLACK for j in (i - 1, i + 1))]
    return 2 * len(good) / (len(x) + len(y))


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def chain(parts) -> int:
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p % 2**64).to_bytes(8, "little"), seed)
    return seed


def test_fingerprints_by_hand(spark):
    docs = sorted(rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"))
    prints = {i: slow_anchors(t or "") for i, t in docs}
    after = dict(zip([i for i, _ in docs], [*docs[1:], docs[0]]))
    texts = dict(docs)
    full = {r.doc_id: r for r in syncmers.fingerprint_edits(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    got = rows(queries.op9_syncmers(spark, SF), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors")
    assert len(got) == len(docs) and len({(tuple(prints[i]), f) for i, _, _, f, *_ in got}) == len({f for _, _, _, f, *_ in got})
    near_edited, near_next = [], []
    for i, n, sha, fp, efp, near, nxt, anchors in got:
        t, q = texts[i] or "", len(texts[i] or "") // 4
        edited = t[: len(t) - q] + (after[i][1] or "")[:q]
        e = slow_anchors(edited)
        assert (n, sha, anchors) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), len(prints[i]))
        assert ([tuple(a) for a in full[i].anchors], [tuple(a) for a in full[i].edited_anchors]) == (prints[i], e)
        assert len(fp) == (32 if prints[i] else 0) and (fp == efp) == (prints[i] == e)
        assert near == pytest.approx(slow_likeness(prints[i], e)) and nxt == pytest.approx(slow_likeness(prints[i], prints[after[i][0]]))
        if len(prints[i]) >= 20 and prints[i] != prints[after[i][0]]:
            near_edited.append(near)
            near_next.append(nxt)
    assert np.mean(np.array(near_edited) > 0.5) > 0.9 and np.median(near_edited) > 0.7 and np.mean(np.array(near_next) < 0.1) > 0.9


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_next_document_over_any_ranges(spark, parts):
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(25)], "doc_id long, text string").repartition(3)
    got = dict(rows(syncmers.with_next(df, parts=parts), "text", "next_text"))
    assert got == {f"t{i}": f"t{(i + 1) % 25}" for i in range(25)}


@pytest.mark.parametrize("parts", [1, 8, 30])
def test_next_document_among_repeated_and_null_ids(spark, parts):
    """A third of the rows share an id, a third have none: they are split by their texts' hashes, in one order."""
    data = [(7, f"seven{i % 35}") for i in range(40)] + [(None, f"none{i}") for i in range(40)] + [(100 + i, f"own{i}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.text, r.next_text) for r in syncmers.with_next(df, parts=parts).collect()]
    key = lambda d: (d[0] is not None, d[0] or 0, xxhash.xxh64_intdigest(d[1].encode(), 42) >> 32, d[1])
    order = sorted(data, key=key)
    assert sorted(got, key=str) == sorted(((*d, order[(i + 1) % len(order)][1]) for i, d in enumerate(order)), key=str)
    assert parts < 8 or syncmers.with_next(df, parts=parts).count() == len(data)


def test_fingerprint_edges(spark, documents, empty):
    got = rows(syncmers.fingerprint_edits(documents), "doc_id", "fingerprint", "n_chars")
    assert len(got) == documents.count() and syncmers.fingerprint_edits(empty).count() == 0
    assert {f for i, f, _ in got if i in (3, 4, 5)} == {""} and len({f for i, f, _ in got if i in (1, 2)}) == 1
    alone = rows(syncmers.fingerprint_edits(documents.where("doc_id = 7")), "near_next")
    assert alone == [(1.0,)]


def test_every_text_with_tokens_has_an_anchor(spark):
    """Texts of 5 and 6 tokens have few k-mers, and often none is a closed syncmer."""
    texts = [" ".join(f"w{n}x{i}y{j}" for j in range(n)) for n in (4, 5, 6, 7) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in syncmers.add_anchors(syncmers.add_anchors(df, "text", "a"), "text", "b", positions=True).collect():
        assert r.a and None not in r.a and [x.hash for x in r.b] == r.a and [tuple(x) for x in r.b] == slow_anchors(r.text)
    got = rows(syncmers.fingerprint_edits(df), "fingerprint", "near_next", "near_edited")
    assert len({f for f, _, _ in got}) == len(texts) and all(f for f, _, _ in got) and {n for _, n, _ in got} == {0.0}


def test_likeness_by_position(spark):
    """Moved passages match; equal anchors scattered over both texts do not."""
    random.seed(3)
    w = [f"w{i}" for i in range(400)]
    scattered = w[:]
    random.shuffle(scattered)
    mixed = [x for i in range(0, 400, 5) for x in (*w[(i * 37) % 400 :][:5], f"new{i}")]
    texts = [" ".join(w), " ".join(w[200:] + w[:200]), " ".join(w[:150] + [f"n{i}" for i in range(60)] + w[150:]), " ".join(scattered), " ".join(mixed), "long " * 5 + "x " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with_anchors = syncmers.add_anchors(df, "text", "a", positions=True)
    pairs = with_anchors.where("doc_id = 0").select(F.col("a").alias("x")).join(with_anchors.select("doc_id", "a"))
    got = dict(rows(pairs.select("doc_id", syncmers.likeness(syncmers.firsts(F.col("x"), 0), syncmers.firsts(F.col("a"), 1)).alias("n")), "doc_id", "n"))
    assert got == pytest.approx({i: slow_likeness(slow_anchors(texts[0]), slow_anchors(t)) for i, t in enumerate(texts)})
    assert got[0] == 1 and got[1] > 0.95 and got[2] > 0.85 and got[3] == got[5] == 0 and got[4] < 0.1


def test_anchors_do_not_depend_on_what_is_elsewhere(spark):
    random.seed(1)
    w = [f"w{random.randrange(99)}" for _ in range(200)]
    df = spark.createDataFrame([(0, " ".join(w)), (1, " ".join(["new", "start", *w]))], "doc_id long, text string")
    a, b = ({(p, h) for p, h in r.out} for r in syncmers.add_anchors(df, "text", "out", positions=True).orderBy("doc_id").collect())
    assert {(p + 2, h) for p, h in a} <= b and 60 < len(a) < 140


# --- URLs


def glob_match(glob: bytes, text: bytes) -> bool:
    import re

    return re.fullmatch(b"".join(b".*" if g == 42 else b"." if g == 63 else re.escape(bytes([g])) for g in glob), text, re.S) is not None


def test_automaton_by_regex():
    random.seed(8)
    globs = [g for g in (bytes(random.choices(b"ab*?", k=random.randint(1, 9))) for _ in range(120)) if g.strip(b"*")]
    texts = [b"", *(bytes(random.choices(b"ab", k=random.randint(0, 12))) for _ in range(300))]
    hit = urlfilter.matches(texts, urlfilter.build(globs))
    for i, t in enumerate(texts):
        assert [glob_match(g, t) for g in globs] == hit[i].tolist(), t


def test_urls(spark):
    urls = {
        "http://A.COM/en/x": ("a.com", "/en/x", "com/en/", "block"), "http://com/en/": ("com", "/en/", "com/en/", "block"), "https://example.com/en/7?x": ("example.com", "/en/7", "example.com/en/7", "allow"),
        "https://myexample.com/en/7": ("myexample.com", "/en/7", "com/en/", "block"), "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"), "http://m.example.net/de/81#a": ("m.example.net", "/de/81", "example.net/de/8", "block"),
        "ftp://b.org?x=http://c.com/en/": ("b.org", "", None, "allow"), "no scheme com/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://x.fr/a.com/en/": ("x.fr", "/a.com/en/", None, "allow"),
        "http://casino.fr/": ("casino.fr", "/", None, "block"), "http://x.fr/casino": ("x.fr", "/casino", None, "allow"), "http://x.fr/a\n.exe": ("x.fr", "/a\n.exe", None, "block"), "http://com.fr/en/": ("com.fr", "/en/", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://u" + "v" * 70000 + ".com/en/": ("u" + "v" * 70000 + ".com", "/en/", "com/en/", "block"),
    }
    df = spark.createDataFrame([(u, "old") for u in urls] * 2, "url string, rule string")
    got = urlfilter.judge(df).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_urls_as_the_sql_says(spark, tmp_path):
    """A page for every rule and every glob, at any depth."""
    import duckdb

    hosts = ["example.com", "a.example.com", "b.net", "example.net", "c.org", "x.casino9.fr", "cheap-pills.de", "a.ads-track.io", "adult-x.fr", "spam-a.fr", "free-bets.it", "plain.fr"]
    paths = ["", "/", "/en/", "/en/7", "/de/8x", "/es/", "/login", "/a/b/login/c", "/x.exe", "/x.exe/y"]
    urls = [f"https://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=/login", "#x.exe")] + [None, "", "nothing"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(str, (tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "glob")) for r in queries.op10_urls(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict, \"glob\" from ({queries.OP10})").fetchall()
    assert got == sorted(map(str, want)) and len({r[5] for r in want}) == len(urlfilter.GLOBS) + 1


def test_hundreds_of_rules():
    """Several hundred rules at once are what each of them says alone."""
    random.seed(9)
    globs = [b"*." + bytes(random.choices(b"abc", k=3)) + b".x\xff/" + bytes(random.choices(b"ab*", k=random.randint(1, 6))) + b"*" for _ in range(400)]
    texts = [b"." + bytes(random.choices(b"abc", k=3)) + b".x\xff/" + bytes(random.choices(b"ab", k=6)) for _ in range(500)]
    hit = urlfilter.matches(texts, urlfilter.build(globs))
    assert hit.any() and all([glob_match(g, t) for g in globs] == hit[i].tolist() for i, t in enumerate(texts[:60]))
