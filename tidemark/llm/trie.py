"""A prefix trie of conversations, with what every subtree would save.

Every prefix of a conversation is a node, keyed by a digest of its turns; an edge joins it to the prefix one turn
shorter.  Leaf counts and savings reach all ancestors by pointer jumping: in round k a node gives what it holds to the
ancestor 2^k above it and takes over that ancestor's pointer, so a trie of any depth d takes log2(d) rounds.

Turns count by number (null first), then role, then the digest of the text; only digests and sizes are shuffled.
Conversations of any length are dealt to blocks of turns, so none has to fit a row or a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .merkle import placed

ROOT = hashlib.sha256(b"").digest()


def link(before: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(before + turn).digest()


def turns(df: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, d, bytes): a digest of role and text (null: empty), and the text's UTF-8 bytes."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    known = df.where(F.col(id).isNotNull())
    return known.select(F.col(id).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)).alias("d"), F.octet_length(t).cast("long").alias("bytes"))


def numbered(rows: DataFrame, size: int) -> DataFrame:
    """(conv, pos, d, bytes): turns numbered from 0 within their conversation, however many one has."""
    leaves, summary = placed(rows, "conv", ["turn", "role", "d"], size)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = None, 0
        for b in batches:
            if len(b):
                run = (b["conv"] != b["conv"].shift()).cumsum()
                pos = b.groupby(run).cumcount()
                if last is None:
                    n = int(b["_before"].iloc[0])
                elif b["conv"].iloc[0] != last:
                    n = 0
                pos[run == 1] += n
                last, n = b["conv"].iloc[-1], int(pos.iloc[-1]) + 1
                yield pd.DataFrame({"conv": b["conv"], "pos": pos, "d": b["d"], "bytes": b["bytes"]})

    # The summary has one row in ``size`` of the turns'.
    return leaves.select("conv", "d", "bytes", "_part").join(F.broadcast(summary.select("_part", "_before")), "_part").mapInPandas(count, "conv long, pos long, d binary, bytes long")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, d, bytes, total) of the rebuilt conversations, and all conversations (conv, total).

    Conversation c: the first h turns of c - c % 5 (all if fewer, none if absent), then its own after its first h;
    h = crc32(decimal c) % 9.
    """
    sizes = rows.groupBy("conv").agg((F.max("pos") + 1).alias("len"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h")
    base = sizes.select(F.col("conv").alias("base"), F.col("len").alias("had"))
    own = sizes.select("conv", "len", h, (F.col("conv") - F.col("conv") % 5).alias("base"))
    taken = F.least(F.col("h"), F.coalesce("had", F.lit(0)))
    known = own.join(base, "base", "left").select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total"))
    known = cut(known)
    rest = rows.join(known, "conv").where(F.col("pos") >= F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d", "bytes", "total")
    # At most eight turns of a conversation go to the four or so others that begin with them.
    heads = rows.where((F.col("pos") < 8) & (F.col("conv") % 5 == 0)).select(F.col("conv").alias("base"), "pos", "d", "bytes")
    first = known.where(F.col("taken") > 0).join(heads, "base").where(F.col("pos") < F.col("taken")).select("conv", "pos", "d", "bytes", "total")
    return rest.unionByName(first), known.select("conv", "total")


def prefixes(rows: DataFrame, block: int = 1024) -> DataFrame:
    """(conv, depth, key, parent, bytes, ends) for every prefix of one turn or more; ends: it is the whole conversation.

    Turns are digested one after the other within a block of positions, each block from an empty start; the digests of the
    blocks before it, in order, are what a later block's keys begin with.  So equal prefixes have equal keys, and only a
    digest per block meets in one row.
    """
    blocks = rows.groupBy("conv", F.floor(F.col("pos") / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "d", "bytes"))).alias("t"), F.max("total").alias("total"))

    def end(turns) -> bytes:
        now = ROOT
        for t in turns:
            now = link(now, t["d"])
        return now

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("b"), pa.array([end(t) for t in batch.column("t").to_pylist()], pa.binary())], names=["conv", "b", "e"])

    def starts(conv: pd.DataFrame) -> pd.DataFrame:
        """What each later block's keys begin with, and the key that its first turn hangs on."""
        conv, now, out = conv.sort_values("b"), b"", []
        for c, b, e in zip(conv["conv"], conv["b"], conv["e"]):
            last, now = (link(now, e) if now else e), link(now, e)
            out.append((c, b + 1, now, last))
        return pd.DataFrame(out, columns=["conv", "b", "start", "hangs"])

    full = blocks.where((F.col("b") + 1) * block < F.col("total")).mapInArrow(ends, "conv long, b long, e binary").groupBy("conv").applyInPandas(starts, "conv long, b long, start binary, hangs binary")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "depth", "key", "parent", "bytes", "ends"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for conv, found, total, start, hangs in zip(*(batch.column(c).to_pylist() for c in ("conv", "t", "total", "start", "hangs"))):
                now, parent = ROOT, ROOT if start is None else hangs
                for t in found:
                    now, depth = link(now, t["d"]), t["pos"] + 1
                    # Behind the first block a key is the digest of the blocks before and of the turns so far in this one.
                    key = now if start is None else link(start, now)
                    for c, v in zip(columns, (conv, depth, key, parent, t["bytes"], depth == total)):
                        c.append(v)
                    parent = key
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return blocks.join(full, ["conv", "b"], "left").mapInArrow(chain, "conv long, depth long, key binary, parent binary, bytes long, ends boolean")


def id_digests(ends: DataFrame, parts: int) -> DataFrame:
    """(key, ends_sha256): the digest of each key's conversation ids, ascending, joined by commas.

    Ids are sorted over partitions and put together to pieces there; the pieces of a key go through one digest in order,
    a batch at a time, so a key that all conversations end at takes no more memory than any other.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            run = (b["key"] != b["key"].shift()).cumsum()
            yield b.assign(piece=b["conv"].astype(str)).groupby(run, as_index=False).agg({"key": "first", "conv": "first", "piece": ",".join})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, p) for b in batches for k, p in zip(b["key"], b["piece"]))
        done: list[tuple] = []
        for key, found in groupby(rows, key=lambda r: r[0]):
            sha = hashlib.sha256(next(found)[1].encode())
            for _, piece in found:
                sha.update(b"," + piece.encode())
            done.append((key, sha.hexdigest()))
            if len(done) == 10_000:
                yield pd.DataFrame(done, columns=["key", "ends_sha256"])
                done = []
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])

    pieces = ends.repartitionByRange(parts, "key", "conv").sortWithinPartitions("key", "conv").mapInPandas(join, "key binary, conv long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "conv").mapInPandas(total, "key binary, ends_sha256 string")


def roll_up(nodes: DataFrame, depth: int) -> DataFrame:
    """(key, n_leaves, saved_tokens) summed over subtrees, from nodes (key, parent, leaf, saved) at most ``depth`` deep.

    After k rounds a node holds the sums of its descendants less than 2^k below it, and points at the ancestor 2^k above
    it.  Sums are combined before they are shuffled; who has no such ancestor drops out of the next round's pointers.
    """
    state = nodes.select("key", F.col("parent").alias("up"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    for _ in range(depth.bit_length()):
        given = state.where(F.col("up").isNotNull()).select(F.col("up").alias("key"), F.lit(None).cast("binary").alias("up"), "n_leaves", "saved_tokens")
        added = state.unionByName(given).groupBy("key").agg(F.max("up").alias("up"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        above = state.where(F.col("up").isNotNull()).select(F.col("key").alias("up"), F.col("up").alias("next"))
        state = cut(added.join(above, "up", "left").select("key", F.col("next").alias("up"), "n_leaves", "saved_tokens"))
    return state.select("key", "n_leaves", "saved_tokens")


def prefix_trie(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 1024, rows: int = 100_000) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: members less one, times the bytes of the last text), ends_sha256, key.

    Null roles and texts are empty; rows without an id take no part; repeated rows are turns of their own.  An empty
    table has no nodes.  Other columns, whatever their names, are ignored.
    """
    raw, convs = rebuilt(cut(numbered(turns(df, id, turn, role, text), rows)))
    raw = cut(prefixes(raw, block))
    root = F.lit(ROOT)
    own = raw.groupBy("key").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("bytes").alias("bytes"), F.count("*").alias("n"))
    top = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).where(F.col("n") > 0).select(root.alias("key"), "conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), "n")
    nodes = own.unionByName(top)
    children = own.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes")))
    size = nodes.agg(F.max("depth"), F.count("*")).first()
    sums = roll_up(nodes, size[0] or 0)
    parents = nodes.where(F.col("n_children") > 0).select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    ends = raw.where("ends").select("key", "conv").unionByName(convs.where("total = 0").select(root.alias("key"), "conv"))
    done = nodes.join(sums, "key").join(parents, "parent", "left").join(id_digests(ends, max(1, -(-size[1] // rows))), "key", "left")
    return done.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "key")
