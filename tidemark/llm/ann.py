"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by distance is the nearest by cosine.  A table hashes a vector by the
cells of a few Gaussian projections; a query visits its own bucket and then perturbed ones, in the order of their
estimated success (the squared distances to the cell walls that are crossed).  The more rows, the more projections and
probes there are (see Plan), so the share of the rows that a query meets falls as the table grows.

A row goes to its bucket's region (the cells of a table's first projections) once a table, and so does a query to each
region that holds some of its probes, with the list of their buckets.  In a region the candidates of each query are
ranked by the exact measure, and tables are merged by a final ranking.  A region of more than BLOCK rows is dealt out in
blocks, to each of which its queries go.  Queries that find fewer than k candidates are compared with all rows, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

TABLES, WIDTH, BLOCK = 16, 3.0, 16_384
#: Tables of regions are broadcast up to so many rows.
FEW_REGIONS = 100_000


@dataclass(frozen=True)
class Plan:
    """How to hash: tables of m projections with cells of ``width``, the first ``coarse`` of which make a region."""

    tables: int
    m: int
    width: float
    probes: int
    coarse: int
    seed: int

    @staticmethod
    def of(rows: int, tables: int = TABLES, width: float = WIDTH, seed: int = 7) -> Plan:
        """Buckets of a few rows each, probes in proportion to the root of the rows, regions of about BLOCK rows."""
        bits = log2(max(rows, 2))
        m = max(6, round(bits) + 1)
        return Plan(tables, m, width, max(40, round(0.8 * rows**0.5)), min(m - 1, max(1, round((bits - log2(BLOCK)) / 1.2))), seed)


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def projections(dim: int, tables: int, m: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * m)), rng.uniform(0, width, tables * m)


def bucket_keys(cells: np.ndarray, dim: int) -> np.ndarray:
    """A long for each row of cell numbers (n, m)."""
    key = np.full(len(cells), 0x9E3779B97F4A7C15 ^ dim, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[1]):
            key = (key ^ cells[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


@lru_cache(maxsize=4)
def probe_sets(m: int, count: int) -> np.ndarray:
    """(sets, 2 m) 0 or 1: the ``count`` sets of walls to cross that are likely best, by the walls' rank in distance.

    Of 2 m walls in order of distance, the i-th and the i-th last are those of one cell, so no set has both.  Ranks stand
    for the expected squared distances of uniform places.
    """
    i = np.arange(1, m + 1)
    low = i * (i + 1) / (4 * (m + 1) * (m + 2))
    cost = np.r_[low, (1 - i / (m + 1) + i * (i + 1) / (4 * (m + 1) * (m + 2)))[::-1]].tolist()
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < count:
        score, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - c in chosen for c in chosen):
            out.append(chosen)
        end = chosen[-1]
        if end + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[end] + cost[end + 1], (*chosen[:-1], end + 1)))
            heapq.heappush(heap, (score + cost[end + 1], (*chosen, end + 1)))
    sets = np.zeros((len(out), 2 * m))
    for r, chosen in enumerate(out):
        sets[r, list(chosen)] = 1
    return sets


def probes_of(cell: np.ndarray, inside: np.ndarray, count: int) -> np.ndarray:
    """Cells (own first, then up to ``count`` perturbed ones, best first) of a query at ``inside`` (0 to 1) of its cell."""
    m = len(cell)
    near = np.concatenate([inside, 1 - inside])
    by_distance = np.argsort(near, kind="stable")
    # Ranks mirror each other by pairs only without ties; a set that holds both walls of a cell moves nowhere there.
    sets = probe_sets(m, 4 * count)
    score = sets @ near[by_distance] ** 2
    best = sets[np.argsort(score, kind="stable")[:count]]
    moves = np.zeros((len(best), m), np.int64)
    for rank, wall in enumerate(by_distance):
        moves[:, wall % m] += (best[:, rank] * (-1 if wall < m else 1)).astype(np.int64)
    return np.concatenate([cell[None], cell[None] + moves])


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of a column of number lists for each length, each row scaled exactly by a power of two."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        mine = np.flatnonzero(sizes == dim)
        x = values[begin[mine][:, None] + np.arange(dim)]
        yield mine, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def located(x: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Cells (n, tables, m) of vectors, and how far into them they are (0 to 1)."""
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    a, b = projections(x.shape[1], plan.tables, plan.m, plan.width, plan.seed)
    place = ((x @ a + b) / plan.width).reshape(len(x), plan.tables, plan.m)
    cells = np.floor(place)
    return cells.astype(np.int64), place - cells


def index_rows(batches: Iterator[pa.RecordBatch], plan: Plan, vectors: bool) -> Iterator[pa.RecordBatch]:
    """A row (tab, cell, and with ``vectors`` id, role 0, keys, v) for each vector and table."""
    for batch in batches:
        for mine, x in matrices(batch.column("v")):
            cells, _ = located(x, plan)
            for t in range(plan.tables):
                where = {"tab": pa.array(np.full(len(mine), t, np.int32)), "cell": pa.array(bucket_keys(cells[:, t, : plan.coarse], x.shape[1]))}
                if vectors:
                    keys = pa.ListArray.from_arrays(np.arange(len(mine) + 1, dtype=np.int32), pa.array(bucket_keys(cells[:, t], x.shape[1])))
                    where |= {"id": batch.column("id").take(pa.array(mine)), "role": pa.array(np.zeros(len(mine), np.int32)), "keys": keys, "v": batch.column("v").take(pa.array(mine))}
                yield pa.RecordBatch.from_pydict(where)


def ask_rows(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """A row (tab, cell, id, role 1, keys, v) for each query, table and region that holds some of its probes."""
    for batch in batches:
        for mine, x in matrices(batch.column("v")):
            cells, inside = located(x, plan)
            for t in range(plan.tables):
                rows, regions, keys = [], [], []
                for i in range(len(mine)):
                    probes = probes_of(cells[i, t], inside[i, t], plan.probes)
                    own, key = bucket_keys(probes[:, : plan.coarse], x.shape[1]), bucket_keys(probes, x.shape[1])
                    for region in np.unique(own):
                        rows.append(mine[i])
                        regions.append(region)
                        keys.append(np.unique(key[own == region]))
                if rows:
                    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), pa.array(np.concatenate(keys)))
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_pydict({"tab": pa.array(np.full(len(rows), t, np.int32)), "cell": pa.array(np.array(regions)), "id": batch.column("id").take(at), "role": pa.array(np.ones(len(rows), np.int32)), "keys": lists, "v": batch.column("v").take(at)})


def ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of each block for each of its queries.

    Rows come sorted by (tab, cell, part, role): a block's rows, at most BLOCK or so, are held while its queries pass.
    """
    held: list[tuple] = []
    index, now = None, None
    for batch in batches:
        tags = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tab", "cell", "part", "role")], axis=1)
        edges = np.r_[0, np.flatnonzero((np.diff(tags, axis=0) != 0).any(axis=1)) + 1, len(tags)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            some, block, role = batch.slice(lo, hi - lo), tuple(tags[lo, :3]), tags[lo, 3]
            if block != now:
                held, index, now = [], None, block
            if role == 0:
                held.append(some)
            elif held:
                index = indexed(held) if index is None else index
                found = [x for x in nearest(some, index, k) if len(x[1])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "vec_id", "score"])


def indexed(parts: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, ...]]:
    """By vector length: sorted bucket keys, ids, and the vectors as they are and at length 1."""
    table = pa.Table.from_batches(parts).combine_chunks()
    keys, ids = table.column("keys").combine_chunks().flatten().to_numpy(), table.column("id").to_numpy()
    out = {}
    for mine, x in matrices(table.column("v").combine_chunks()):
        order = np.argsort(keys[mine], kind="stable")
        x = x[order]
        out[x.shape[1]] = keys[mine][order], ids[mine][order], x, x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return out


def nearest(asks: pa.RecordBatch, index: dict[int, tuple[np.ndarray, ...]], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row, score) of each query's k nearest rows in the buckets that it probes."""
    ids, lists = asks.column("id").to_numpy(), asks.column("keys")
    for mine, y in matrices(asks.column("v")):
        if y.shape[1] not in index:
            continue
        keys, rows, x, unit = index[y.shape[1]]
        for i, v in zip(mine, y):
            probes = lists[int(i)].values.to_numpy()
            lo, hi = np.searchsorted(keys, probes, "left"), np.searchsorted(keys, probes, "right")
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at = at[rows[at] != ids[i]]
            if len(at) > k:  # rounding apart, the nearest; then the measure itself
                rough = unit[at] @ v
                at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9 * np.sqrt(v @ v)]
            score = cosine(v[None], x[at])[0]
            best = np.lexsort((rows[at], -score))[:k]
            yield np.full(len(best), ids[i]), rows[at[best]], score[best]


def cosine(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of all pairs, each summed component by component, so equal vectors have equal scores wherever they are."""
    dot, yy, xx = np.zeros((len(y), len(x))), np.zeros(len(y)), np.zeros(len(x))
    for d in range(y.shape[1]):
        dot += y[:, d, None] * x[None, :, d]
        yy += y[:, d] * y[:, d]
        xx += x[:, d] * x[:, d]
    return dot / (np.sqrt(yy)[:, None] * np.sqrt(xx)[None, :])


FOUND = "query_id long, vec_id long, score double"


def search(df: DataFrame, query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, plan: Plan | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``query`` marks the k nearest other rows found, by cosine.

    Nearest first, ties to the smaller id; all candidates if there are fewer than k.  Vectors that are null, zero or
    hold null or non-finite components take no part, nor do null ids; vectors of different lengths never meet.  Of
    rows with the same id and vector one counts.  Scores are sums in double precision after an exact scaling, so neither
    very large nor very small components overflow.  Candidates are what the probed buckets hold: recall is measured,
    not promised.
    """
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    data = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(query, F.lit(False)).alias("query"))
    data = cut(data.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"]))
    plan = plan or Plan.of(data.count())
    asked = data.where("query").select("id", "v")
    whole = f"tab int, cell long, id long, role int, keys array<long>, v {kind}"
    regions = data.select("v").mapInArrow(lambda b: index_rows(b, plan, False), "tab int, cell long").groupBy("tab", "cell").count()
    rows = data.select("id", "v").mapInArrow(lambda b: index_rows(b, plan, True), whole)
    found = cut(_merge(_meet(rows, asked.mapInArrow(lambda b: ask_rows(b, plan), whole), regions, k), k))
    few = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")), F.col("id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k)
    few = cut(few.select("id", "v"))
    if not few.isEmpty():
        everywhere = lambda rows, role: rows.select(F.lit(-1).alias("tab"), F.size("v").cast("long").alias("cell"), "id", F.lit(role).alias("role"), F.array(F.lit(0).cast("long")).alias("keys"), "v")
        regions = data.groupBy(F.lit(-1).alias("tab"), F.size("v").cast("long").alias("cell")).count()
        found = _merge(found.drop("rank").unionByName(_meet(everywhere(data, 0), everywhere(few, 1), regions, k)), k)
    return found.select("query_id", "rank", F.col("vec_id").alias(id), "score")


def _meet(rows: DataFrame, asks: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """What each query finds in each block.  regions: number of rows by (tab, cell)."""
    parts = cut(regions.select("tab", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    parts = F.broadcast(parts) if parts.count() <= FEW_REGIONS else parts
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = rows.join(parts, ["tab", "cell"]).withColumn("part", own).drop("parts").unionByName(asks.join(parts, ["tab", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    return dealt.repartition("tab", "cell", "part").sortWithinPartitions("tab", "cell", "part", "role").mapInArrow(lambda b: ranked(b, k), FOUND)


def _merge(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
