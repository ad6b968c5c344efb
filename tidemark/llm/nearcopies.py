"""Near copies by exact similarity: SimHash links are candidates, and each is checked on the shingle sets of both texts.

Texts with the same set of shingles are one node.  In a first pass every node meets the most central node of
those that it is linked to in a key, so a large group of copies is joined by a few checks a node: copies are near what
they were made from, seldom near each other.  Sketches of the shingle sets tell which of these pairs to check.  A second
pass takes the groups of linked nodes that hold several components: it looks at all candidate pairs that are not in one
component yet, and those whose sketches leave a similarity of NEAR possible are checked.  So the components are those of all candidate pairs that are similar enough, whatever the groups' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, unused
from .simhash import blocks, components, fingerprints_of, forest, keys_first, remixed, spread_join, trie_pairs

#: Two texts are near copies if the Jaccard similarity of their shingle sets is at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
SHINGLE = 5
#: Rows expanded, and node pairs walked, at once: some ten arrays of longs each.
CHUNK = 200_000
#: A sketch's bits, how many shingles it is made of at most (about), and how many standard deviations it may be off.
SKETCH, SAMPLE, SIGMAS = 512, 300, 4.0
#: Rows are found by a broadcast of their ids up to so many (some 50 bytes each).
FEW_TEXTS = 100_000
#: More ids are broadcast as bitmaps, 4 KB for 32 768 numbers in a row, up to so many; ids further apart cost a shuffle of the rows.
MOST_BITMAPS = 4096


def shingles_of(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z lower-cased; fewer words than width are one shingle of them all."""
    import xxhash

    words = data.lower().split()
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(max(0, len(words) - width + 1) if width else 0, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - width + 1 + i]
    return np.unique(out)


def level_of(n: np.ndarray) -> np.ndarray:
    """By what power of two the shingles of sets of n are thinned for their sketches."""
    return np.ceil(np.log2(np.maximum(n, SAMPLE) / SAMPLE)).astype(np.int64)


def sketch_of(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """Two sketches of a shingle set: its SimHash (signed), and an odd sketch (parities of SKETCH bins) as longs."""
    mixed = remixed(shingles, 1).astype(np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(mixed), 65536):
        ones += np.unpackbits(mixed[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    simhash = int.from_bytes(np.packbits(2 * ones > len(mixed)).tobytes(), "big", signed=True)
    again = remixed(shingles, 2).astype(np.uint64)
    level = int(level_of(np.array([len(shingles)]))[0])
    if level:
        again = again[(again >> np.uint64(64 - level)) == 0]
    odd = np.bincount((again & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return simhash, np.packbits(odd.astype(np.uint8)).view(np.int64)


def possible(size_a: np.ndarray, size_b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether odd sketches that differ in ``apart`` bits leave a similarity of NEAR possible, to SIGMAS deviations.

    Sets of different levels cannot be told apart by their sketches and are always possible.
    """
    level = level_of(size_a)
    keep = 0.5**level
    most = (size_a + size_b) * (NEAR[1] - NEAR[0]) / (NEAR[1] + NEAR[0]) * keep
    fade = np.exp(-2.0 * most / SKETCH)
    mean = SKETCH / 2 * (1 - fade)
    spread = SKETCH / 4 * (1 - fade * fade) - most * fade * fade + most * (1 - keep) * fade * fade
    return (level != level_of(size_b)) | (apart <= mean + SIGMAS * np.sqrt(np.maximum(spread, 0)) + 1)


def sig_of(shingles: np.ndarray) -> int:
    """Hash (unsigned) of a shingle set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def add_marks(df: DataFrame, prints: int) -> DataFrame:
    """Add ``m``: fps (SimHashes of the distinct words), sig (hash of the shingle set), n (its size), sim and odd (see sketch_of)."""

    def compute(data: pd.Series) -> pd.DataFrame:
        def marks(text: bytes) -> tuple:
            shingles = shingles_of(text)
            return fingerprints_of(text, 1, 42, prints, True), sig_of(shingles), len(shingles), *sketch_of(shingles)

        # One text's shingles at a time.
        fps, sig, n, sim, odd = map(list, zip(*map(marks, data))) if len(data) else ([],) * 5
        return pd.DataFrame({"fps": fps, "sig": np.array(sig, np.uint64).view(np.int64), "n": np.array(n, np.int32), "sim": np.array(sim, np.int64), "odd": odd})

    return df.withColumn("m", F.pandas_udf(compute, "fps array<long>, sig long, n int, sim long, odd array<long>")(text_of().cast("binary")))


def groups_of(part: np.ndarray, fp: np.ndarray, max_distance: int) -> Iterator[tuple]:
    """For each number of print and choice: (the choice, row numbers by word, distinct words, key bits, starts, counts)."""
    choices = list(combinations(range(max_distance + 2), 2))
    order = np.argsort(part, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        own = choices[part[mine[0]] % len(choices)]
        words, key_bits = keys_first(fp[mine].view(np.uint64), own, max_distance)
        yield own, mine, words, key_bits


def gathered(batches: Iterator[pa.RecordBatch], *names: str) -> list[np.ndarray] | None:
    data = [tuple(b.column(n).to_numpy(zero_copy_only=False) for n in names) for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*data)] if data else None


def hub_groups(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """What a partition's nodes are linked to within a key: rows (part, lead, sig, hub), a group by (part, lead).

    part: number of the fingerprint and of the choice of blocks; sim: SimHash of the shingle set, whose majority over
    the linked nodes is their centre; hub: the node nearest to it, null where (sig, hub) is no pair to check.  A pair
    comes only out of its first two blocks, so the pairs of all keys together connect what is linked in any; groups that
    agree on two blocks before are left out.  lead: a fingerprint of the group's.
    """
    data = gathered(batches, "part", "fp", "sig", "sim")
    if data is None:
        return
    part, fp, sig, sim = data
    masks = [np.uint64(((1 << w) - 1) << low) for low, w in blocks(max_distance)]
    for own, mine, words, key_bits in groups_of(part, fp, max_distance):
        words, word = np.unique(words, return_inverse=True)
        parent = np.arange(len(words))
        for budget in sorted({min(1, max_distance), min(2, max_distance), max_distance}):

            def wanted(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
                """False where all words of both ranges are linked already."""
                changes = np.r_[0, np.cumsum(np.diff(parent) != 0)]  # noqa: B023
                return ~((changes[a_lo] == changes[a_hi - 1]) & (changes[b_lo] == changes[b_hi - 1]) & (parent[a_lo] == parent[b_lo]))  # noqa: B023

            for i, j in trie_pairs(words, key_bits, budget, wanted, CHUNK):
                parent = forest(len(words), i, j, parent)
        root = parent[word]
        many = np.bincount(root, minlength=len(words))[root] > 1
        rows, root = mine[many], root[many]
        if not len(rows):
            continue
        order = np.lexsort((sig[rows], root))
        rows, root = rows[order], root[order]
        starts = np.flatnonzero(np.r_[True, np.diff(root) != 0])
        counts = np.diff(np.r_[starts, len(rows)])
        bits = np.unpackbits(sim[rows].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits.astype(np.int32), starts, axis=0)
        centre = np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").astype(np.uint64)[:, 0]
        off = np.bitwise_count(sim[rows].view(np.uint64) ^ np.repeat(centre, counts))
        at = np.repeat(rows[np.lexsort((sig[rows], off, root))[starts]], counts)
        hub, bits = sig[at], (fp[rows] ^ fp[at]).view(np.uint64)
        # Linked nodes that agree on two blocks before these are linked, through some hub, where those are the key.
        before = np.cumsum([(bits & masks[i]) == 0 for i in range(own[1])], axis=0)[-1] > 1
        new = (sig[rows] != hub) & ~(before & (np.bitwise_count(bits) <= max_distance))
        agreed = np.sum([np.logical_and.reduceat((bits & masks[i]) == 0, starts) for i in range(own[1])], axis=0)
        told = new | np.repeat(agreed < 2, counts)
        lead = np.repeat(fp[rows[starts]], counts)
        columns = [pa.array(part[rows[told]], pa.int32()), pa.array(lead[told]), pa.array(sig[rows[told]]), pa.array(hub[told], mask=~new[told])]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "lead", "sig", "hub"])


def hub_pairs(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """The pairs (u > v) of hub_groups."""
    data = gathered((b.filter(b.column("hub").is_valid()) for b in hub_groups(batches, max_distance)), "sig", "hub")
    if data is not None:
        pairs = np.unique(np.stack([np.maximum(*data), np.minimum(*data)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def runs(weights: np.ndarray) -> Iterator[slice]:
    """Slices of at most CHUNK in weight, or one element."""
    at, total = 0, np.cumsum(weights)
    while at < len(weights):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        yield slice(at, end)
        at = end


def spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [begin, begin + count), and which range each is of."""
    which = np.repeat(np.arange(len(count)), count)
    return begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count), which


def cross_pairs(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """All pairs (u > v) of a partition's nodes within max_distance bits, in two components, that sizes and sketches let be near.

    part: number of the fingerprint and of the choice of blocks; root: the component; odd: the odd sketch, as bytes.
    """
    data = gathered(batches, "part", "fp", "sig", "root", "n", "odd")
    if data is None:
        return
    part, fp, sig, root, size, odd = data
    size = size.astype(np.int64)
    sketch = np.frombuffer(b"".join(odd.tolist()), np.uint64).reshape(len(odd), -1)
    masks = [np.uint64(((1 << w) - 1) << low) for low, w in blocks(max_distance)]
    for own, mine, words, key_bits in groups_of(part, fp, max_distance):
        sort = np.lexsort((root[mine], words))
        mine = mine[sort]
        words, start, count = np.unique(words[sort], return_index=True, return_counts=True)
        changes = np.r_[0, np.cumsum(np.diff(root[mine]) != 0)]

        def wanted(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
            """False where all nodes of both ranges of words are of one component."""
            ends = [start[lo] for lo in (a_lo, b_lo)], [start[hi - 1] + count[hi - 1] - 1 for hi in (a_hi, b_hi)]
            one = [changes[x] == changes[y] for x, y in zip(*ends)]
            return ~(one[0] & one[1] & (root[mine[ends[0][0]]] == root[mine[ends[0][1]]]))

        same = np.flatnonzero((count > 1) & wanted(*(np.arange(len(words)) + x for x in (0, 1, 0, 1))))
        for i, j in chain([(same, same)], trie_pairs(words, key_bits, max_distance, wanted, CHUNK)):
            for outer in runs(count[i]):
                a, of = spread(start[i[outer]], count[i[outer]])
                js = j[outer][of]
                for inner in runs(count[js]):
                    b, of_a = spread(start[js[inner]], count[js[inner]])
                    a_at = a[inner][of_a]
                    left, right = mine[a_at], mine[b]
                    x, y = size[left], size[right]
                    ok = (a_at < b) & (root[left] != root[right]) & (np.minimum(x, y) * NEAR[1] >= np.maximum(x, y) * NEAR[0])
                    # A pair comes only out of the first two blocks that it agrees on.
                    apart = (fp[left] ^ fp[right]).view(np.uint64)
                    for at in range(own[1]):
                        ok &= (at == own[0]) | ((apart & masks[at]) != 0)
                    left, right = left[ok], right[ok]
                    bits = np.bitwise_count(sketch[left] ^ sketch[right]).sum(axis=1)
                    near = possible(size[left], size[right], bits)
                    left, right = sig[left[near]], sig[right[near]]
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(left, right)), pa.array(np.minimum(left, right))], names=["u", "v"])


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) with ``may``: whether sizes and sketches leave it possible that they are near."""

    def compute(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        x, y = x.to_numpy(np.int64), y.to_numpy(np.int64)
        left, right = (np.frombuffer(b"".join(v.tolist()), np.uint64).reshape(len(v), -1) for v in (a, b))
        return pd.Series((np.minimum(x, y) * NEAR[1] >= np.maximum(x, y) * NEAR[0]) & possible(x, y, np.bitwise_count(left ^ right).sum(axis=1)))

    # A hub's pairs meet its sketch, and below its set, in skew joins: both sides come from a shuffle of their own.
    side = lambda c: nodes.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), packed(F.col("odd")).alias(f"odd_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", F.pandas_udf(compute, "boolean")("odd_u", "odd_v", "n_u", "n_v").alias("may"))


def ends_of(pairs: DataFrame) -> DataFrame:
    """(sig): the distinct nodes of pairs (u, v).  Each side is made distinct where it lies: a hub is one row a task, not one a pair."""
    side = lambda c: pairs.select(F.col(c).alias("sig")).distinct()
    return side("u").unionByName(side("v")).distinct()


def rows_of(df: DataFrame, id: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is in the one column of ids: distinct, not null, and cheap to read twice.

    Texts stay where they are: ids are broadcast, many of them as bitmaps, which take as much room for one as for 32 768 in a row.
    """
    (name,), own = ids.columns, df[id].cast("long")
    bucket, bits = unused(df, "bucket"), unused(df, "bits")
    maps = ids.groupBy(F.bitmap_bucket_number(name).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias(bits), F.count("*").alias("n"))
    n_ids, n_maps = maps.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if n_ids <= FEW_TEXTS or n_maps > MOST_BITMAPS:
        return df.join(F.broadcast(ids) if n_ids <= FEW_TEXTS else ids, own == ids[name], "left_semi")
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substr(F.col(bits), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return df.join(F.broadcast(maps.drop("n")), F.bitmap_bucket_number(own) == F.col(bucket)).where(held).select(*df.columns)


def checked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) with ``near``: whether their shingle sets are.  nodes: sig, and id of a text that has this set."""

    def compute(data: pd.Series) -> pd.DataFrame:
        sets = [shingles_of(x) for x in data]
        return pd.DataFrame({"sig": np.array([sig_of(x) for x in sets], np.uint64).view(np.int64), "set": pd.Series([x.view(np.int64) for x in sets], dtype="object")})

    asked = cut(ends_of(pairs).join(nodes.select("sig", "id"), "sig").select("id").distinct())
    # Another text of an asked id comes along, and no pair asks for its set.
    found = rows_of(texts, "id", asked).select(F.pandas_udf(compute, "sig long, set array<long>")(text_of().cast("binary")).alias("x"))
    sets = cut(found.groupBy("x.sig").agg(F.first("x.set").alias("set")))
    both = pairs.join(sets.select(F.col("sig").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("sig").alias("v"), F.col("set").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("u", "v", (common * NEAR[1] >= (F.size("a") + F.size("b") - common) * NEAR[0]).alias("near"))


def dealt(nodes: DataFrame, max_distance: int, *columns: Column | str) -> DataFrame:
    """A row for each fingerprint and choice of blocks of a node, (part, fp, *columns), keys together in a partition."""
    parts, rows = blocks(max_distance), []
    for i, j in combinations(range(len(parts)), 2):
        held = [F.shiftrightunsigned("fp", parts[x][0]).bitwiseAND(F.lit((1 << parts[x][1]) - 1)) for x in (i, j)]
        rows.append(F.shiftleft(held[0], parts[j][1]).bitwiseOR(held[1]))
    prints = nodes.select("*", F.posexplode("fps").alias("k", "fp"))
    every = prints.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("choice"))
    key = F.coalesce(*(F.when(F.col("part") % len(rows) == c, row) for c, row in enumerate(rows)))
    return every.select((F.col("k") * len(rows) + F.col("choice")).alias("part"), "fp", *columns).repartition("part", key)


def unsettled(groups: DataFrame, roots: DataFrame, nodes: DataFrame, max_distance: int) -> DataFrame:
    """Rows for cross_pairs: the groups (part, lead, sig) that hold several components, a group in a partition.

    roots: (node, root), as from components; other nodes are on their own.  Sketches go to these groups alone, not to
    every key of a node.
    """
    placed = cut(groups.join(roots, F.col("sig") == F.col("node"), "left").select("part", "lead", "sig", F.coalesce("root", "sig").alias("root")))
    mixed = placed.groupBy("part", "lead").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("part", "lead")
    marks = nodes.select("sig", "fps", "n", packed(F.col("odd")).alias("odd"))
    fp = F.get("fps", F.floor(F.col("part") / len(list(combinations(blocks(max_distance), 2)))).cast("int"))
    return placed.join(mixed, ["part", "lead"]).join(marks, "sig").select("part", "lead", fp.alias("fp"), "sig", "root", "n", "odd").repartition("part", "lead")


def near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", prints: int = 6, max_distance: int = 4) -> DataFrame:
    """(id, component_id) for each distinct id that is not null: component_id is the smallest id of its near copies.

    Candidates are texts with fingerprints of their distinct words within max_distance bits (any of ``prints``); a link
    is a candidate whose shingle sets are near, or rows of one id.  Texts without words are copies of each other.
    """
    texts = df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    marked = cut(add_marks(texts, prints).select("id", "m.*"))
    nodes = cut(marked.groupBy("sig").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("fps", "n", "sim", "odd"))))

    groups = cut(dealt(nodes, max_distance, "sig", "sim").mapInArrow(lambda b: hub_groups(b, max_distance), "part int, lead long, sig long, hub long"))
    central = groups.where("hub is not null").select(F.greatest("sig", "hub").alias("u"), F.least("sig", "hub").alias("v"))
    first = cut(plausible(central.distinct(), nodes))
    told = cut(checked(first.where("may").select("u", "v"), texts, nodes))
    links = told.where("near").select("u", "v")
    apart = first.where("not may").select("u", "v").unionByName(told.where("not near").select("u", "v"))
    if apart.isEmpty():
        second = links.limit(0)
    else:
        rest = unsettled(groups, components(links), nodes, max_distance).mapInArrow(lambda b: cross_pairs(b, max_distance), "u long, v long")
        second = checked(cut(rest.distinct()), texts, nodes).where("near").select("u", "v")

    of_id = marked.groupBy("id").agg(F.min("sig").alias("v"))
    one_id = marked.select("id", "sig").join(of_id, "id").where("sig <> v").select(F.col("sig").alias("u"), "v")
    roots = components(links.unionByName(second).unionByName(one_id))
    named = cut(marked.select("id", "sig").join(roots, F.col("sig") == F.col("node"), "left").select("id", F.coalesce("root", "sig").alias("root")).distinct())
    least = cut(named.groupBy("root").agg(F.min("id").alias("component_id")))
    return named.join(least, "root").select(F.col("id").alias(id), "component_id")


def packed(longs: Column) -> Column:
    """An array of longs as bytes, the lowest byte of each first."""
    return F.unhex(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of df whose id is the smallest of its near copies, all columns kept.

    A row that is repeated in every column stays once; rows of one id that differ somewhere all stay.  Rows with a null
    id all stay: nothing tells which document they are.
    """
    smallest, n = near_copies(df, id, text, **how), unused(df, "rows")
    sizes = df.where(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("i")).agg(F.count("*").alias(n))
    stay = cut(smallest.where(F.col(id) == F.col("component_id")).join(sizes, F.col(id) == F.col("i")).select("i", n))
    out = rows_of(df, id, stay.where(F.col(n) == 1).select("i"))
    # Only rows of ids that have several can be repeated.
    several = stay.where(F.col(n) > 1).select("i")
    out = out if several.isEmpty() else out.unionByName(rows_of(df, id, several).dropDuplicates())
    return out.unionByName(df.where(F.col(id).isNull()))
