"""Languages, Merkle manifests and prefix tries, against plain definitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import duck
from compare import rows as same
from data import SF
from pyspark.sql import functions as F
from tidemark.llm import langid, merkle, queries, trie

SHA = lambda text: hashlib.sha256(text.encode()).hexdigest()

# --- languages

SAID = {
    "en": ["the cat and the dog went to the house", "this is what they think of the thing"], "de": ["der Hund und die Katze gehen in das Haus", "das ist nicht was sie von der Sache denken"],
    "el": ["η γάτα και ο σκύλος πήγαν στο σπίτι", "αυτό είναι που σκέφτονται"],
}
ODD = [None, "", " \t\n", "123 ²³ ½!", "a", "A" * 5000, "été", "the " * 60_000 + "und", "日本語のテキスト", "áb x̀", "x" * 47 + "é" + "y" * 200, "İstanbul", "the cat\x00der Hund"]


@pytest.fixture
def spoken(spark):
    rows = [(i, t, lang, "old", 5) for i, (lang, t) in enumerate((lang, t) for lang, texts in SAID.items() for t in texts * 3)]
    rows += [(100, "", "empty", "old", 5), (101, None, "null", "old", 5), (102, "words without a language", None, "old", 5), (None, "xyzzy", "nowhere", "old", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, t string, margin int")


def test_profiles_by_counting(spoken):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = langid.train(spoken, ~held, ranks=50)
    want = {}
    for lang, texts in SAID.items():
        own = [r["text"] for r in spoken.where(F.col("lang") == lang).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
        counts = langid.gram_counts(own)
        want[lang] = sorted(counts, key=lambda g: (-counts[g], g))[:50]
    assert got == want
    assert langid.train(spoken.where("false")) == {}
    assert set(langid.train(spoken, most=1, languages=2)) < set(SAID) | {"nowhere"}


def test_distances_by_definition(spark, spoken):
    profiles = langid.train(spoken, F.col("doc_id").isNotNull())
    docs = spark.createDataFrame([(i, t, "old", 1.0) for i, t in enumerate([*ODD, ODD[7]] + [x for texts in SAID.values() for x in texts])], "doc_id long, text string, lang_pred string, t double")
    for r in langid.predict(docs, profiles).collect():
        n, off = langid.distances(r.text or "", profiles)
        assert r.t == 1.0
        if not n:
            assert (r.lang_pred, r.score, r.margin) == ("und", 0.0, 0.0)
        else:
            best = sorted(off, key=lambda x: (off[x], x))
            assert (r.lang_pred, r.score) == (best[0], 1 - off[best[0]] / (langid.RANKS * n)) and abs(r.margin - (off[best[1]] - off[best[0]]) / (langid.RANKS * n)) < 1e-12
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(docs.where("false"), profiles).count() == 0


def test_long_texts_in_parts(monkeypatch):
    random.seed(3)
    text = " ".join("".join(random.choices("abcdé", k=random.randint(1, 60))) for _ in range(3000))
    whole = langid.counted(text)
    monkeypatch.setattr(langid, "AT_ONCE", 100)
    parts = langid.counted(text)
    assert all((a == b).all() for a, b in zip(whole, parts))
    counts = langid.gram_counts([text])
    assert dict(zip(whole[0].tolist(), whole[1].tolist())) == {langid.code(g): n for g, n in counts.items()}


def test_language_query(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op11_langid(spark, SF).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r.lang_pred == truth[r.doc_id].lang for r in out if r.held_out]
    assert sum(held) / len(held) > 0.97


# --- manifests


def plain_manifest(rows):
    """{(doc_id, leaf): {(subroot, root, proof, folded)}} of (doc_id, lang, leaf, tampered) rows, level by level."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([SHA("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, i, proof, now):
        for level in levels[:-1]:
            run = i // 8 * 8
            left, right = level[run:i], level[i + 1 : run + 8]
            proof, now, i = proof + "".join(left + right), SHA("".join([*left, now, *right])), i // 8
        return proof, now

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        groups[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    trees = [tree([r[2] for r in groups[x]]) for x in langs]
    top, out = tree([t[-1][0] for t in trees]), defaultdict(set)
    for k, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            proof, now = climb(trees[k], i, "", r[3] or r[2])
            proof, now = climb(top, k, proof, now)
            out[r[0], r[2]].add((trees[k][-1][0], top[-1][0], proof, now))
    return out


@pytest.fixture
def spread(spark):
    """Small shuffles stay in as many partitions as on a cluster."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("rows,langs", [(3, 4), (20, 2), (7, 40), (1000, 9), (5, 1)])
def test_manifest_by_levels(spark, spread, rows, langs):
    """Partitions of any size, groups within one and over many of them, ids missing, repeated and alike in all."""
    random.seed(rows)
    data = [(random.choice([None, *range(200)]), random.choice([None, *[f"l{'é' * (i % 3)}{i}" for i in range(langs)]]), random.choice([None, "", f"text {i}", "same"])) for i in range(150)]
    data += [(5, "l0", "copy")] * 90
    df = spark.createDataFrame([(*r, "old", 1) for r in data], "doc_id long, lang string, text string, leaf string, _part int")
    leaf = merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("text"))
    other = F.when(F.col("doc_id") % 3 == 0, merkle.leaf(F.col("doc_id"), F.col("lang"), F.upper("text")))
    got = merkle.manifest(df, leaf, other, rows=rows).collect()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    digest = lambda i, lang, t: SHA(said(i) + said(lang) + said(t))
    want = plain_manifest([(i, lang, digest(i, lang, t), digest(i, lang, t if t is None else t.upper()) if i is not None and i % 3 == 0 else None) for i, lang, t in data])
    found = defaultdict(set)
    for r in got:
        assert r.verified == (r.folded_root == r.root)
        found[r.doc_id, r.leaf].add((r.subroot, r.root, r.proof, r.folded_root))
    assert len(got) == len(data) and found == want


def test_forests_are_a_monoid():
    """Any order and any bracketing of the parts folds to the same forest."""
    random.seed(1)
    sizes = {0: 70, 1: 1, 2: 9}
    nodes = [{"tree": t, "size": n, "level": 0, "idx": i, "digest": SHA(f"{t}/{i}")} for t, n in sizes.items() for i in range(n)]
    whole = merkle.packed(merkle.fold(merkle.unpacked([nodes]), 3))
    assert len(whole) == 1
    for _ in range(20):
        random.shuffle(nodes)
        parts = [nodes[i : i + 11] for i in range(0, len(nodes), 11)]
        while len(parts) > 1:
            a, b = parts.pop(random.randrange(len(parts))), parts.pop(random.randrange(len(parts)))
            parts.append(merkle.packed(merkle.fold(merkle.unpacked([a, b]), 3)))
        assert parts[0] == whole


def test_manifest_of_little(spark):
    df = spark.createDataFrame([(None, None, None)], "doc_id long, lang string, text string")
    [r] = merkle.manifest(df, merkle.leaf(F.col("doc_id"), F.col("lang"), F.col("text"))).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == SHA("---") and r.proof == "" and r.verified
    assert merkle.manifest(df.where("false"), merkle.leaf(F.col("text"))).count() == 0


# --- tries


def plain_trie(turns):
    """Node rows of (conv, turn, role, text), straight from the definition."""
    convs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            r, t = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest(), t))
    own = {c: [(r, t) for _, _, r, _, t in sorted(rows)] for c, rows in convs.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        new = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(new) + 1):
            members[new[:d]].append((c, len(new)))
    out = {}
    for node, who in members.items():
        ends = sorted(c for c, n in who if n == len(node))
        below = [m for m in members if m[: len(node)] == node]
        childless = lambda m: not any(len(x) == len(m) + 1 and x[:-1] == m for x in members)
        saved = sum((len(members[m]) - 1) * (len(m[-1][1].encode()) if m else 0) for m in below)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out[min(c for c, _ in who), len(node)] = (parent, len(who), sum(len(x) == len(node) + 1 and x[:-1] == node for x in members), sum(map(childless, below)), saved, SHA(",".join(map(str, ends))))
    return out


def trie_rows(df, **how):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.prefix_trie(df, **how).collect()}


@pytest.mark.parametrize("block,rows,parts", [(1024, 100_000, 2), (3, 7, 3), (1, 50, 1)])
def test_trie_by_definition(spark, spread, block, rows, parts):
    """Shared openings, copies, turns missing or alike, short and absent bases, one long conversation; blocks of any size."""
    random.seed(block)
    turns = []
    for c in [*range(-7, 0), *range(0, 40, 1), 51, 52, 1000003]:
        if c % 10 == 5:
            continue
        n = random.choice([0, 1, 2, 3, 9, 12]) if c != 8 else 60
        for i in range(n):
            turns.append((c, random.choice([None, i, i, i]), random.choice([None, "user", "assistant"]) if c % 3 else "user", random.choice([None, "", "é", f"hello {i}"]) if c % 4 else f"same {i}"))
    turns += turns[:9] + [(None, 0, "user", "nobody's")] * 3
    df = spark.createDataFrame([(*t, 1, "old") for t in turns], "conv_id long, turn int, role string, text string, key int, parent string").repartition(parts)
    assert trie_rows(df, block=block, rows=rows) == plain_trie(turns)


def test_trie_of_little(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie_rows(spark.createDataFrame([], schema)) == {} == trie_rows(spark.createDataFrame([(None, 1, "user", "x")], schema))
    alone = [(4, 1, None, None)]  # h is 3 and there is no conversation 0: no turns are left
    assert trie_rows(spark.createDataFrame(alone, schema)) == plain_trie(alone)


@pytest.mark.parametrize("name", ["op12_merkle", "op13_trie"])
def test_same_rows_as_sql(spark, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck(SF).execute(queries.oracle_sql()[name]).df()
    assert same(got) == same(want)
