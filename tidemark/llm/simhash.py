"""SimHash near-duplicate groups by a binary-trie self-join.

The distributed part is a pigeonhole: 64 bits fall into ``max_distance + 2`` blocks, and two fingerprints that differ in
at most ``max_distance`` bits agree on at least two whole blocks.  Each distinct fingerprint goes once to every pair of
blocks, keyed by what it holds there (6 small rows of 24 bytes for the usual 2 bits), so a key has ~26-32 exact bits
and stays small however the corpus grows; copies of a fingerprint were merged before.  Inside a partition the
fingerprints, with the key bits moved to the front, form a binary trie (a sorted array: a node is a range).  Pairs of
nodes are walked down together, differing bits add up, and a pair of nodes goes as soon as its bits exceed the budget.

Only a spanning forest of the links leaves a partition.  Components follow by alternating large-star and small-star
steps, joins and minima only, with a reliable checkpoint after each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, without

#: Node pairs walked at once; more are put aside, so memory stays bounded.
FRONTIER = 2_000_000


def fingerprints_of(data: bytes, width: int = 3, seed: int = 42, prints: int = 1, distinct: bool = False) -> list[int]:
    """Signed 64-bit SimHashes of a text's bytes; see add_fingerprints."""
    import xxhash

    digest, words = xxhash.xxh64_digest, data.lower().split()
    if not words:
        return [0] * prints
    if len(words) < width:
        words = [b" ".join(words)]
    elif width > 1:
        words = [b" ".join(x) for x in zip(*(words[i:] for i in range(width)))]
    if distinct:
        words = list(dict.fromkeys(words))
    counts = np.zeros((prints, 64), np.int64)
    for at in range(0, len(words), 65536):
        part = np.frombuffer(b"".join([digest(w, seed) for w in words[at : at + 65536]]), ">u8")
        for k in range(prints):
            bits = np.unpackbits(remixed(part, k).view(np.uint8).reshape(-1, 8), axis=1)
            counts[k] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * c > len(words)).tobytes(), "big", signed=True) for c in counts]


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Big-endian hashes as they are for k = 0, else independent ones made of them (SplitMix64's finaliser)."""
    if k == 0:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(">u8")


def add_fingerprints(df: DataFrame, text: str = "text", width: int = 3, seed: int = 42, prints: int = 1, distinct: bool = False, out: str = "fps") -> DataFrame:
    """Add the SimHashes (array of ``prints`` longs) of each text: A-Z lower-cased, shingles of ``width`` words, XXH64.

    A bit is 1 if set in over half the hashes.  Repeats of a shingle count, unless ``distinct``.  Fewer words than
    ``width``: one shingle of them all.  No words, or a null text: 0.  A column named like ``out`` is replaced.
    """

    def compute(data: pd.Series) -> pd.Series:
        return pd.Series([fingerprints_of(x, width, seed, prints, distinct) for x in data], dtype="object")

    return without(df, out).withColumn(out, F.pandas_udf(compute, "array<long>")(text_of(text).cast("binary")))


def blocks(max_distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the ``max_distance + 2`` blocks of 64 bits."""
    n = max_distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def keys_first(words: np.ndarray, choice: tuple[int, int], max_distance: int) -> tuple[np.ndarray, int]:
    """The words with the chosen blocks moved to the top, and how many bits those have."""
    all_blocks = blocks(max_distance)
    order = [*choice, *(i for i in range(len(all_blocks)) if i not in choice)]
    out, used = np.zeros_like(words), 0
    for i in order:
        low, width = all_blocks[i]
        used += width
        out |= ((words >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(64 - used)
    return out, sum(all_blocks[i][1] for i in choice)


def trie_pairs(words: np.ndarray, key_bits: int, budget: int, wanted: Callable | None = None, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted distinct words that agree on the top key_bits and differ in at most budget bits below.

    wanted(a_lo, a_hi, b_lo, b_hi), if given, says which pairs of ranges can hold a pair of interest; others are left.
    frontier: node pairs walked at once.
    """
    if len(words) < 2:
        return
    edges = np.flatnonzero(np.diff(words >> np.uint64(64 - key_bits))) + 1
    lo, hi = np.r_[0, edges], np.r_[edges, len(words)]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    todo = [(63 - key_bits, lo, hi, lo, hi, np.zeros(len(lo), np.int8))] if len(lo) else []
    while todo:
        bit, a_lo, a_hi, b_lo, b_hi, diff = todo.pop()
        if len(diff) > frontier:
            half = len(diff) // 2
            todo += [(bit, *(x[:half] for x in (a_lo, a_hi, b_lo, b_hi, diff))), (bit, *(x[half:] for x in (a_lo, a_hi, b_lo, b_hi, diff)))]
            continue
        if bit < 0:
            apart = a_lo != b_lo
            yield a_lo[apart], b_lo[apart]
            continue
        # A node's words are a range, and those with a 1 at this bit are its last ones.
        a_mid, b_mid = middle(words, a_lo, a_hi, bit), middle(words, b_lo, b_hi, bit)
        same = a_lo == b_lo
        parts = [
            (a_lo, a_mid, b_lo, b_mid, diff, None),
            (a_mid, a_hi, b_mid, b_hi, diff, None),
            (a_lo, a_mid, b_mid, b_hi, diff + 1, None),
            (a_mid, a_hi, b_lo, b_mid, diff + 1, ~same),
        ]
        kept = []
        for p, q, r, s, d, more in parts:
            ok = (p < q) & (r < s) & (d <= budget) & ~((p == r) & (q - p == 1))
            ok = ok if more is None else ok & more
            if wanted is not None:
                ok[ok] = wanted(*(x[ok] for x in (p, q, r, s)))
            kept.append(tuple(x[ok] for x in (p, q, r, s, d)))
        merged = [np.concatenate(x) for x in zip(*kept)]
        if len(merged[-1]):
            todo.append((bit - 1, *merged))


def middle(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index in each range [lo, hi) whose word has a 1 at bit; hi if there is none.  Above it the range agrees."""
    target = ((words[lo] >> np.uint64(bit)) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(words, target), lo, hi)


def forest(n: int, left: np.ndarray, right: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the given links (and those already in parent)."""
    parent = np.arange(n) if parent is None else parent
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def partition_links(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """The spanning forest (id, smaller id) of a partition's links; the partition holds whole keys."""
    data = [tuple(b.column(n).to_numpy(zero_copy_only=False) for n in ("k", "choice", "fp", "id")) for b in batches]
    if not data:
        return
    k, choice, fp, ids = (np.concatenate(x) for x in zip(*data))
    uids, node = np.unique(ids, return_inverse=True)
    parent, pairs = np.arange(len(uids)), list(combinations(range(max_distance + 2), 2))
    part = k.astype(np.int64) * len(pairs) + choice
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order])) + 1
    for mine in np.split(order, edges):
        if len(mine) < 2:
            continue
        words, key_bits = keys_first(fp[mine].view(np.uint64), pairs[choice[mine[0]]], max_distance)
        words, at = np.unique(words, return_index=True)
        index = node[mine[at]]
        for i, j in trie_pairs(words, key_bits, max_distance):
            parent = forest(len(uids), index[i], index[j], parent)
    moved = np.flatnonzero(parent != np.arange(len(uids)))
    yield pa.RecordBatch.from_arrays([pa.array(uids[moved]), pa.array(uids[parent[moved]])], names=["u", "v"])


def near_links(points: DataFrame, max_distance: int = 2) -> DataFrame:
    """Links (u > v) between ids, as forests of what differs in at most max_distance bits.

    points: ``k`` (which fingerprint of a text), ``fp`` and ``id``, distinct by (k, fp); ids are not null.
    """
    parts = blocks(max_distance)
    rows = []
    for c, (i, j) in enumerate(combinations(range(len(parts)), 2)):
        held = [F.shiftrightunsigned("fp", parts[x][0]).bitwiseAND(F.lit((1 << parts[x][1]) - 1)) for x in (i, j)]
        rows.append(F.struct(F.lit(c).alias("choice"), F.shiftleft(held[0], parts[j][1]).bitwiseOR(held[1]).alias("key")))
    dealt = points.select("k", "fp", "id", F.explode(F.array(*rows)).alias("x")).select("k", "x.choice", "x.key", "fp", "id")
    return dealt.repartition("k", "choice", "key").select("k", "choice", "fp", "id").mapInArrow(lambda b: partition_links(b, max_distance), "u long, v long")


def spread_join(big: DataFrame, small: DataFrame, on: str, by: str, ways: int = 16) -> DataFrame:
    """big joined with small, which has one row per ``on`` at most; rows of big with one ``on`` go to ``ways`` tasks by ``by``."""
    salted = big.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    return salted.join(small.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))), [on, "_way"]).drop("_way")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id that each linked node reaches, by alternating large-star and small-star steps.

    A hub's links are spread over several tasks where they meet its minimum.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(small)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, prints: int = 1, distinct: bool = False, max_distance: int = 2) -> DataFrame:
    """One row per input row: ``id``, ``fp`` (the first fingerprint) and ``component_id``.

    Fingerprints within max_distance bits are linked, and component_id is the smallest id reachable over links, itself
    included.  With several ``prints`` per text, texts are linked where any of them are.  Equal fingerprints (ties,
    repeated rows, all empty texts) are one node, and rows of one id are one document.  A row with a null id gets the
    component of its fingerprint (null if no row with an id has that fingerprint).  An empty table gives no rows.
    """
    marked = cut(add_fingerprints(df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), "text", width, seed, prints, distinct).select("id", "fps"))
    alike = marked.groupBy("fps").agg(F.min("id").alias("id"))
    each = alike.where("id is not null").select("id", F.posexplode("fps").alias("k", "fp"))
    points = each.groupBy("k", "fp").agg(F.min("id").alias("id"))
    links = near_links(points, max_distance)
    if prints > 1:  # texts that one fingerprint tells apart may share another
        shared = each.withColumnRenamed("id", "u").join(points.withColumnRenamed("id", "v"), ["k", "fp"]).where("u <> v")
        links = links.unionByName(shared.select("u", "v"))
    roots = components(links)
    named = alike.join(roots, F.col("id") == F.col("node"), "left").select("fps", F.coalesce("root", "id").alias("component_id"))
    return marked.join(named, "fps").select(F.col("id").alias(id), F.get("fps", F.lit(0)).alias("fp"), "component_id")


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of df whose id is the smallest of its near-duplicate group, all columns kept.

    A row that is repeated in every column stays once; rows of one id that differ somewhere all stay.  Rows with a null id all stay: nothing tells which document they are.
    """
    stay = near_groups(df.where(F.col(id).isNotNull()), id, text, **how).select(F.col("component_id").alias("_stay")).distinct()
    kept = df.join(stay, df[id] == F.col("_stay"), "left_semi").dropDuplicates()
    return kept.unionByName(df.where(F.col(id).isNull()))
