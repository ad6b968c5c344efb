"""The pipeline's near copies against brute force on shingle sets."""

import random

import corpus_pipeline as P
import numpy as np
from data import SF
from tidemark.llm import nearcopies


def rows(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_groups(docs):
    """Smallest id of each document's group, by all pairs."""
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j] and near(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def edited(words, n):
    words = list(words)
    for at in random.sample(range(len(words)), n):
        words[at] = f"e{random.randrange(10**6)}"
    return " ".join(words)


def test_only_near_texts_are_copies(spark):
    """Same words in another order, and heavy edits, are candidates but no copies; light edits and chains are."""
    random.seed(3)
    base = [f"w{random.randrange(400)}" for _ in range(300)]
    turned = sorted(base)
    texts = [" ".join(base), " ".join(turned), " ".join(base).upper(), edited(base, 4), edited(base, 3), edited(base, 25), edited(turned, 2), " ".join(base[:290]), "", " \t", None, "one", "ONE", "two one", "a b c d e", "a b c d f"]
    docs = list(enumerate(texts))
    got = dict(rows(nearcopies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "component_id"))
    assert got == slow_groups(docs) and got[1] == 1 and got[5] == 5
    kept = rows(P.drop_near_copies(spark, spark.createDataFrame([*docs, (None, "one"), (0, texts[0])], "doc_id long, text string"), SF), "doc_id")
    assert sorted(i for (i,) in kept if i is not None) == sorted(set(got.values())) and (None,) in kept


def test_near_copies_of_the_table(spark):
    docs = sorted(rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text"))
    got = dict(rows(nearcopies.near_copies(spark.read.parquet(f"{SF}/documents.parquet")), "doc_id", "component_id"))
    assert got == slow_groups(docs)


def test_cross_pairs_are_all_pairs(monkeypatch):
    """Every pair of two components within the budget, once, however rows are chunked; also equal words."""
    import pyarrow as pa
    from itertools import combinations
    from tidemark.llm.simhash import blocks

    random.seed(5)
    monkeypatch.setattr(nearcopies, "CHUNK", 7)
    heads = [random.getrandbits(64) for _ in range(6)]
    fps = [random.choice(heads) ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 3))) % 2**64 for _ in range(150)]
    fp = np.array(fps + fps[:20], np.uint64).view(np.int64)
    sig, n = np.arange(len(fp)) * 7 - 300, np.array([random.choice([8, 9, 20]) for _ in fp])
    root = np.array([random.choice([1, 2, s]) for s in sig.tolist()])
    parts = len(list(combinations(blocks(4), 2)))
    level = nearcopies.sketch_of(np.arange(1, 9, dtype=np.uint64) * np.uint64(77777777777))[1].tobytes()
    col = lambda x, kind: pa.array(np.tile(x, parts), kind)
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts), len(fp)), pa.int32()), col(fp, pa.int64()), col(sig, pa.int64()), col(root, pa.int64()), col(n, pa.int32()), pa.array([level] * (parts * len(fp)), pa.binary())], names=["part", "fp", "sig", "root", "n", "odd"])
    got = [p for b in nearcopies.cross_pairs(iter([batch]), 4) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    bits = lambda i, j: int(np.bitwise_count(np.uint64(int(fp[i]) % 2**64) ^ np.uint64(int(fp[j]) % 2**64)))
    want = {(int(max(sig[i], sig[j])), int(min(sig[i], sig[j]))) for i, j in combinations(range(len(fp)), 2) if bits(i, j) <= 4 and root[i] != root[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_sketches_let_near_sets_pass():
    """All pairs of similarity 0.8 and over are possible, nearly all below 0.6 are not, at any size."""
    rng = np.random.default_rng(1)
    for size in (5, 20, 150, 320, 900, 5000):
        passed = {}
        for share in (0.8, 0.85, 0.6):
            n = 0
            for _ in range(60):
                common = rng.integers(0, 2**63, max(1, round(size * 2 * share / (1 + share))), dtype=np.uint64)
                more = max(0, size - len(common))
                a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, more, dtype=np.uint64)]) for _ in range(2))
                if share >= 0.8 and 5 * len(common) < 4 * (len(common) + 2 * more):
                    b = common
                apart = np.bitwise_count(nearcopies.sketch_of(a)[1].view(np.uint64) ^ nearcopies.sketch_of(b)[1].view(np.uint64)).sum()
                if share < 0.8 or 5 * len(common) >= 4 * len(np.union1d(a, b)):
                    n += bool(nearcopies.possible(np.array([len(a)]), np.array([len(b)]), apart)[0])
                else:
                    n += 1
            passed[share] = n
        assert passed[0.8] == passed[0.85] == 60 and (size < 150 or passed[0.6] < 10), (size, passed)


def test_a_large_group_is_joined_by_few_checks(spark):
    """Copies with up to six edits each: near the original or not, as brute force says; pairs grow with the group, not its square."""
    random.seed(11)
    base = [f"w{random.randrange(400)}" for _ in range(150)]
    docs = [(0, " ".join(base)), *((i, edited(base, 1 + i % 6)) for i in range(1, 240))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dict(rows(nearcopies.near_copies(df), "doc_id", "component_id"))
    want = slow_groups(docs)
    assert sum(got[i] != want[i] for i in want) <= 2 and sum(g == 0 for g in got.values()) > 100
    marked = nearcopies.add_marks(df.withColumnRenamed("doc_id", "id"), 6).select("m.*")
    pairs = nearcopies.dealt(marked, 4, "sig", "sim").mapInArrow(lambda b: nearcopies.hub_pairs(b, 4), "u long, v long").distinct().count()
    assert pairs < 50 * len(docs)


def test_trie_walk_in_small_steps():
    """The pairs do not depend on how many node pairs are walked at once, and are those of brute force."""
    from tidemark.llm.simhash import trie_pairs

    rng = np.random.default_rng(5)
    flips = np.uint64(1) << rng.integers(0, 43, (120, 3), dtype=np.uint64)
    words = np.unique(np.bitwise_xor.reduce(flips, axis=1))
    want = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if np.bitwise_count(words[i] ^ words[j]) <= 4}
    for frontier in (100, 2_000_000):
        got = [(min(x), max(x)) for i, j in trie_pairs(words, 21, 4, None, frontier) for x in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_groups_of_several_components_hold_all_cross_pairs():
    """What hub_groups leaves out holds no pair: from its groups come the pairs of brute force."""
    import pyarrow as pa
    from collections import defaultdict
    from itertools import combinations
    from tidemark.llm.simhash import blocks

    random.seed(9)
    heads = [random.getrandbits(64) for _ in range(9)]
    fps = [random.choice(heads) ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 3))) % 2**64 for _ in range(160)]
    fp = np.array(fps + fps[:20], np.uint64).view(np.int64)
    sig = np.arange(len(fp)) * 7 - 300
    root = dict(zip(sig.tolist(), (random.choice([1, 2, s]) for s in sig.tolist())))
    parts = len(list(combinations(blocks(4), 2)))
    tile = lambda x: pa.array(np.tile(x, parts), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts), len(fp)), pa.int32()), tile(fp), tile(sig), tile(sig * 12345)], names=["part", "fp", "sig", "sim"])
    groups = defaultdict(list)
    for b in nearcopies.hub_groups(iter([batch]), 4):
        for part, lead, s in zip(*(b.column(i).to_pylist() for i in range(3))):
            groups[part, lead].append((part, int(fp[(s + 300) // 7]), s, root[s], 8))
    mixed = [x for g in groups.values() if len({r[3] for r in g}) > 1 for x in g]
    level = nearcopies.sketch_of(np.arange(1, 9, dtype=np.uint64) * np.uint64(77777777777))[1].tobytes()
    columns = [pa.array(x, kind) for x, kind in zip(zip(*mixed), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([level] * len(mixed), pa.binary())], names=["part", "fp", "sig", "root", "n", "odd"])
    got = [p for b in nearcopies.cross_pairs(iter([batch]), 4) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    bits = lambda i, j: int(np.bitwise_count(np.uint64(int(fp[i]) % 2**64) ^ np.uint64(int(fp[j]) % 2**64)))
    want = {(int(sig[j]), int(sig[i])) for i, j in combinations(range(len(fp)), 2) if bits(i, j) <= 4 and root[int(sig[i])] != root[int(sig[j])]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert len(mixed) < parts * len(fp)


def test_the_second_pass_reads_few_rows(spark, monkeypatch):
    """Sketches go to groups of several components only: a row or so a print and node, not one for each of its 90 keys."""
    random.seed(13)
    docs = []
    for _ in range(20):
        base = [f"w{random.randrange(3000)}" for _ in range(200)]
        docs += [" ".join(base), " ".join(sorted(base)), edited(base, 2)]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: seen.append(self) or real(self, *a, **k))
    assert dict(rows(nearcopies.near_copies(df), "doc_id", "component_id")) == slow_groups(docs)
    assert len(seen) == 2 and 0 < seen[1].count() < 30 * len(docs)


def test_many_ids_find_their_rows_where_they_are(spark, monkeypatch):
    """Ids beyond those that are broadcast one by one go as bitmaps, so no text is shuffled; ids far apart are joined."""
    random.seed(17)
    ids = sorted({*range(-70000, 70001, 97), -32769, -32768, -32767, -1, 0, 1, 32767, 32768, 32769, 2**40, -(2**63), 2**63 - 1})
    docs = spark.createDataFrame([*((i, f"t{i}") for i in ids), (ids[0], "again"), (None, "none")], "doc_id long, text string")
    wanted = [i for i in ids if random.random() < 0.6 or abs(i) > 2**39]
    asked = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    want = sorted((i, t) for i, t in rows(docs, "doc_id", "text") if i in set(wanted))
    monkeypatch.setattr(nearcopies, "FEW_TEXTS", 100)
    found = nearcopies.rows_of(docs, "doc_id", asked)
    assert sorted(rows(found, "doc_id", "text")) == want and found.columns == docs.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and "SortMergeJoin" not in plan and "text" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)
    monkeypatch.setattr(nearcopies, "MOST_BITMAPS", 3)
    assert sorted(rows(nearcopies.rows_of(docs, "doc_id", asked), "doc_id", "text")) == want


def test_bitmaps_give_the_same_groups(spark, monkeypatch):
    """All of near copies with every set of ids as bitmaps, repeated rows among them; no exchange of the result carries texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.where("doc_id % 11 = 0").selectExpr(*("cast(null as long) as doc_id" if c == "doc_id" else c for c in docs.columns)))
    want = sorted(rows(nearcopies.keep_one(docs), "doc_id", "text"), key=repr)
    monkeypatch.setattr(nearcopies, "FEW_TEXTS", 0)
    assert sorted(rows(nearcopies.keep_one(docs), "doc_id", "text"), key=repr) == want
    plan = nearcopies.keep_one(docs.where("doc_id % 7 > 0"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
