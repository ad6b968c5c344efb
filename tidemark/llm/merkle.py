"""A Merkle manifest of a dataset: a root digest, and for each row a proof that holds it to the root.

Rows are leaves, in order, of one tree per group, and the groups' subroots are the leaves of a tree on top.  Every FAN
consecutive nodes become one, the digest of their digests, until one is left.  Leaves lie sorted over partitions.  What
a partition knows is a sparse forest: nodes keyed by (tree, level, index).  Forests form a monoid: merging two is putting
their nodes together and folding each run of siblings whose number is known (FAN, or what the end of the level leaves)
as soon as it is complete.  ``forests`` reduces them as a tree, sixteen to one a round, and keeps every round; ``outside``
goes down again and gives each partition the folded forest of everything else, which is just what its rows' proofs need
besides its own leaves.  A forest has some 14 nodes a level, whatever the partition holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FAN, TOP, REDUCE = 8, -1, 16
NODES = "array<struct<tree:bigint,size:bigint,level:int,idx:bigint,digest:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field is ``-`` if null, else its length in bytes, a colon and the value, as text."""

    def said(c: Column) -> Column:
        v = c.cast("string")
        return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))

    return F.sha2(F.concat(*map(said, fields)), 256)


# --- forests: {tree: (size, {level: {index: digest}})}


def climb(levels: dict[int, dict[int, str]], size: int, drop: bool) -> int:
    """Fold complete runs upwards, level by level; with drop, folded nodes go.  Returns the root's level."""
    level, width = 0, size
    while width > 1:
        here = levels.get(level, {})
        runs: dict[int, list[int]] = {}
        for i in here:
            runs.setdefault(i // FAN, []).append(i)
        for run, members in runs.items():
            if len(members) == min(FAN, width - FAN * run):
                members.sort()
                levels.setdefault(level + 1, {})[run] = digest("".join(here[i] for i in members))
                if drop:
                    for i in members:
                        del here[i]
        level, width = level + 1, -(-width // FAN)
    return level


def fold(forest: dict, trees: int, drop: bool = True) -> dict:
    """The forest with every complete run folded, finished trees being leaves of the top tree of ``trees`` leaves."""
    top = forest.setdefault(TOP, (trees, {}))[1]
    for tree in [t for t in forest if t != TOP]:
        size, levels = forest[tree]
        root = climb(levels, size, drop)
        if 0 in levels.get(root, {}):
            top.setdefault(0, {})[tree] = levels[root][0]
            if drop:
                del forest[tree]
    climb(top, trees, drop)
    return forest


def packed(forest: dict) -> list[dict]:
    return [{"tree": t, "size": size, "level": level, "idx": i, "digest": d} for t, (size, levels) in forest.items() for level, at in levels.items() for i, d in at.items()]


def unpacked(parts) -> dict:
    """One forest of many lists of nodes."""
    forest: dict = {}
    for nodes in parts:
        for n in nodes:
            forest.setdefault(n["tree"], (n["size"], {}))[1].setdefault(n["level"], {})[n["idx"]] = n["digest"]
    return forest


# --- sorted leaves


def placed(df: DataFrame, group: str, order: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """df sorted over partitions of about ``rows`` rows by group and order (``_part``: the partition's number), and one row
    per partition: the number of its first group (``_tree``), that group's rows before it (``_before``), the sizes of its
    first and last group over all partitions (``_first``, ``_last``), and the number of all groups (``_trees``).

    Rows alike in all keys may be split anywhere, so a key that many rows share is no hot partition.
    """
    parts = max(1, -(-df.count() // rows))
    keys = [group, *order, "_salt"]
    ranged = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    leaves = cut(ranged.drop("_salt").withColumn("_part", F.spark_partition_id().cast("long")))
    runs = leaves.groupBy(group, "_part").agg(F.count("*").alias("n"))
    own = Window.partitionBy(group)
    runs = runs.select(F.struct(group).alias("g"), "_part", "n", F.coalesce(F.sum("n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"), (F.min("_part").over(own) == F.col("_part")).cast("long").alias("new"))
    ends = runs.groupBy("_part").agg(F.sum("new").alias("new"), F.min_by("before", "g").alias("_before"), F.min_by("total", "g").alias("_first"), F.max_by("total", "g").alias("_last"))
    # One row per partition, so one in ``rows`` of the table's, in one task.
    every = Window.orderBy("_part")
    base = F.coalesce(F.sum("new").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summary = ends.select("_part", (base - (F.col("_before") > 0).cast("long")).alias("_tree"), "_before", "_first", "_last", F.sum("new").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_trees"))
    return leaves, cut(summary)


def indexed(rows: pd.DataFrame, group: str) -> pd.DataFrame:
    """tree, idx and size of the rows of one partition, which are in order and carry its row of the summary."""
    g = rows[group]
    new = ((g != g.shift()) & ~(g.isna() & g.shift().isna())).to_numpy().copy()
    new[0] = False
    tree = new.cumsum()
    at = pd.Series(range(len(rows)))
    begin = at.groupby(tree).transform("min")
    idx, size = at - begin, at.groupby(tree).transform("size")
    one = rows.iloc[0]
    idx[tree == 0] += int(one["_before"])
    size[tree == 0] = int(one["_first"])
    size[tree == tree[-1]] = int(one["_last"])
    return pd.DataFrame({"tree": tree + int(one["_tree"]), "idx": idx, "size": size})


def forest_of(rows: pd.DataFrame, group: str) -> tuple[dict, pd.DataFrame]:
    at, forest = indexed(rows, group), {}
    for tree, size, i, d in zip(at["tree"].tolist(), at["size"].tolist(), at["idx"].tolist(), rows["leaf"]):
        forest.setdefault(tree, (size, {0: {}}))[1][0][i] = d
    return forest, at


# --- up and down


def forests(leaves: DataFrame, summary: DataFrame, group: str) -> list[DataFrame]:
    """(gid, trees, nodes) by round: the forests of the partitions, of every sixteen of them, and so on to the whole."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        if len(rows):
            trees = int(rows["_trees"].iloc[0])
            yield pd.DataFrame({"gid": [int(rows["_part"].iloc[0])], "trees": [trees], "nodes": [packed(fold(forest_of(rows, group)[0], trees))]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        trees = int(rows["trees"].iloc[0])
        return pd.DataFrame({"gid": [int(rows["gid"].iloc[0]) // REDUCE], "trees": [trees], "nodes": [packed(fold(unpacked(rows["nodes"]), trees))]})

    schema = f"gid long, trees long, nodes {NODES}"
    # A partition's summary is five numbers, one in ``rows`` of the table's rows; the partitions stay as they are.
    rounds = [cut(leaves.select(group, "leaf", "_part").join(F.broadcast(summary), "_part").mapInPandas(own, schema))]
    last = summary.agg(F.max("_part")).first()[0] or 0
    while last > 0:
        rounds.append(cut(rounds[-1].groupBy(F.floor(F.col("gid") / REDUCE)).applyInPandas(merge, schema)))
        last //= REDUCE
    return rounds


def outside(rounds: list[DataFrame]) -> DataFrame:
    """(gid, nodes) for each partition: the folded forest of all other partitions."""

    def deal(inside: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i in range(len(inside)):
            parts = [*around["nodes"], *(n for j, n in enumerate(inside["nodes"]) if j != i)]
            out.append((int(inside["gid"].iloc[i]), packed(fold(unpacked(parts), int(inside["trees"].iloc[i])))))
        return pd.DataFrame(out, columns=["gid", "nodes"])

    now = rounds[-1].select("gid", F.array().cast(NODES).alias("nodes"))
    for inside in reversed(rounds[:-1]):
        parent = inside.withColumn("up", F.floor(F.col("gid") / REDUCE))
        now = parent.groupBy("up").cogroup(now.groupBy("gid")).applyInPandas(deal, f"gid long, nodes {NODES}")
    return now


def proofs(rows: pd.DataFrame, around: list, group: str, trees: int) -> pd.DataFrame:
    """subroot, root, proof (the siblings' digests, level by level) and folded root of the rows of one partition."""
    forest, at = forest_of(rows, group)
    for tree, (size, levels) in unpacked([around]).items():
        mine = forest.setdefault(tree, (size, {}))[1]
        for level, nodes in levels.items():
            mine.setdefault(level, {}).update(nodes)
    fold(forest, trees, drop=False)
    known: dict = {}

    def siblings(tree: int, level: int, i: int) -> tuple[str, str] | None:
        """Left and right siblings of a node, put together; None for a root."""
        key = (tree, level, i)
        if key not in known:
            size, levels = forest[tree]
            width = -(-size // FAN**level)
            run = i // FAN * FAN
            here = levels[level]
            known[key] = None if width == 1 else ("".join(here[k] for k in range(run, i)), "".join(here[k] for k in range(i + 1, min(run + FAN, width))))
        return known[key]

    def way(tree: int, i: int, level: int = 0) -> list[tuple[str, str]]:
        out = []
        while (pair := siblings(tree, level, i)) is not None:
            out.append(pair)
            level, i = level + 1, i // FAN
        return out

    def root(tree: int) -> str:
        levels = forest[tree][1]
        return levels[max(levels)][0]

    above: dict = {}
    whole, out = root(TOP), []
    for tree, i, own, other in zip(at["tree"].tolist(), at["idx"].tolist(), rows["leaf"], rows["tampered"]):
        first = siblings(tree, 0, i)
        key = (tree, i // FAN)
        if key not in above:
            above[key] = [*(way(tree, i // FAN, 1) if first else []), *way(TOP, tree)]
        steps = [first, *above[key]] if first else above[key]
        now = own if other is None else other
        for left, right in steps:
            now = digest(left + now + right)
        out.append((root(tree), whole, "".join(a + b for a, b in steps), now))
    return pd.DataFrame(out, columns=["subroot", "root", "proof", "folded_root"])


def manifest(df: DataFrame, leaf: Column, tampered: Column | None = None, group: str = "lang", order: str = "doc_id", rows: int = 50_000) -> DataFrame:
    """(order, leaf, subroot, root, proof, folded_root, verified) for each row of df.

    ``leaf``: the row's digest (see leaf()); ``tampered``: another digest to be held to the root in its place, null for
    none.  Leaves of a group ascend by ``order`` (null first), then by digest; groups ascend with null first.  ``proof``
    is the siblings' digests in order, empty for a single row.  verified: the root folded from the tampered digest (else
    the leaf) and the original siblings is the root.  Rows of equal digests are interchangeable.  An empty table has no
    rows and no root.  Only digests are shuffled; ``rows`` leaves or so make a partition, which one task holds.
    """
    out = df.select(F.col(order).alias("_id"), F.col(group).alias("_group"), leaf.alias("leaf"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    leaves, summary = placed(out, "_group", ["_id", "leaf"], rows)
    around = outside(forests(leaves, summary, "_group"))

    def prove(own: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["_id", "leaf", "subroot", "root", "proof", "folded_root"])
        own = own.sort_values("_at", ignore_index=True)
        found = proofs(own, rest["nodes"].iloc[0], "_group", int(own["_trees"].iloc[0]))
        return pd.concat([own[["_id", "leaf"]], found], axis=1)

    # Ids as text: pandas has no null among integers.
    ordered = leaves.withColumn("_at", F.monotonically_increasing_id()).withColumn("_id", F.col("_id").cast("string")).join(F.broadcast(summary), "_part")
    done = ordered.groupBy("_part").cogroup(around.groupBy("gid")).applyInPandas(prove, "_id string, leaf string, subroot string, root string, proof string, folded_root string")
    return done.select(F.col("_id").cast(leaves.schema["_id"].dataType).alias(order), "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
