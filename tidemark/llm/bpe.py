"""Byte-level BPE: whole texts to token ids and back.

A text longer than a chunk and its overlap is pre-tokenised in overlapping chunks, each a row of its own that any task
may scan.  A chunk may begin inside a pre-token, but the pattern never looks behind, so as soon as two neighbouring
scans share a boundary in their overlap they agree from there on: the text is cut at the first such boundary, the pieces
are encoded as rows again, and their ids are put together by number.  Where an overlap holds no common boundary (one
endless run), what is left of the text is one piece.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused, without

CHUNK, OVERLAP = 32_768, 1_024
#: Code points before a chunk's end in which its boundaries can still be wrong (a contraction is three long).
BLIND = 4


@lru_cache(maxsize=2)
def encoder(ranks: bytes, pattern: str):
    """tiktoken's encoder for the content of a rank file; once per Python worker."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def compiled(pattern: str):
    import regex

    return regex.compile(pattern)


def scan(text: str, pattern: str, last: bool = True) -> list[int]:
    """Where pre-tokens begin if only this text is seen; if more follows it, less the last ones, which could be wrong."""
    starts = [m.start() for m in compiled(pattern).finditer(text)]
    return starts if last else starts[: bisect_left(starts, len(text) - BLIND)]


def edges(text: str, pattern: str, last: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Where a chunk's text can be cut: in the overlap with the chunk before it, and (less ``chunk``) in that with the next.

    Before white space after something else, so that each side reads the same alone.
    """
    at = [b for b in scan(text, pattern, last) if b and text[b] in " \n\t\r" and not text[b - 1].isspace()]
    return at[: bisect_left(at, overlap)], [] if last else [b - chunk for b in at[bisect_left(at, chunk) :]]


def arrow_list(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids", keep: tuple[str, ...] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``out`` (array<int>): the token ids of the whole text, as tiktoken's
    encode_ordinary gives them.

    ranks: the content of a rank file (a fixed vocabulary of under 1 MB, which is broadcast).  A null text is empty and
    gives no ids; rows stay as they are, repeated ones too; a column named like ``out`` is replaced.
    """
    df = without(df, out) if out.lower() != text.lower() else df
    keep = tuple(c for c in df.columns if keep is None or c in keep)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch], source: str, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            for part in slices(batch, source):
                ids = arrow_list([enc.encode_to_numpy(x or "", disallowed_special=()) for x in part.column(source).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), ids], names=[*columns, out])

    ids = T.StructField(out, T.ArrayType(T.IntegerType(), False))
    long = F.coalesce(F.length(text), F.lit(0)) > chunk + overlap
    whole = df.where(~long).select(*dict.fromkeys([*keep, text])).mapInArrow(lambda b: run(b, text, keep), T.StructType([*(df.schema[c] for c in keep), ids]))

    hash = unused(df, "hash")
    rows = df.where(long).withColumn(hash, F.sha2(text, 256))
    cut_up = pieces(rows.select(F.col(hash).alias("_text"), F.col(text).alias("_t")), pattern, chunk, overlap)
    coded = cut_up.mapInArrow(lambda b: run(b, "_piece", ("_text", "_n")), T.StructType([cut_up.schema["_text"], cut_up.schema["_n"], ids]))
    joined = coded.groupBy("_text").agg(F.flatten(F.sort_array(F.collect_list(F.struct("_n", out)))[out]).alias(out))
    return whole.unionByName(rows.select(*keep, hash).join(joined.withColumnRenamed("_text", hash), hash).select(*keep, out))


def pieces(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_text, _n, _piece): long texts (_text: a hash, _t) cut where neighbouring chunks agree; repeated texts once."""
    last = F.ceil((F.length("_t") - overlap) / chunk).cast("int") - 1
    part = lambda c: F.struct(c.alias("_c"), F.substr("_t", c * chunk + 1, F.lit(chunk + overlap)).alias("_s"), (c == last).alias("_last"))
    chunks = texts.select("_text", F.explode(F.transform(F.sequence(F.lit(0), last), part)).alias("x")).select("_text", "x.*").dropDuplicates(["_text", "_c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [edges(x, pattern, end, chunk, overlap) for x, end in zip(batch.column("_s").to_pylist(), batch.column("_last").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_text"), batch.column("_c"), *(pa.array([x[i] for x in both], pa.list_(pa.int32())) for i in (0, 1))], names=["_text", "_c", "head", "tail"])

    found = chunks.mapInArrow(run, "_text string, _c int, head array<int>, tail array<int>")
    w = Window.partitionBy("_text").orderBy("_c")
    met = found.withColumn("at", F.when(F.col("_c") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w)))))
    # Behind the first pair without a common boundary nothing is known to be right: all of it belongs to one piece.
    met = met.withColumn("at", F.when(F.count(F.when(F.col("at").isNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0, F.col("at")))
    cuts = met.select("_text", "_c", "at", F.lead("at").over(w).alias("end"), F.max(F.when(F.col("at").isNotNull(), F.col("_c"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_n"))
    begin = F.coalesce("at", F.lit(0))
    end = F.when(F.col("_last"), F.length("_s")).otherwise(chunk + F.coalesce("end", F.lit(0)))
    segments = chunks.join(cuts, ["_text", "_c"]).select("_text", "_n", "_c", F.substr("_s", begin + 1, end - begin).alias("s"))
    return segments.groupBy("_text", "_n").agg(F.array_join(F.sort_array(F.collect_list(F.struct("_c", "s")))["s"], "").alias("_piece"))


def slices(batch: pa.RecordBatch, column: str, most: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in parts of few rows, so that what is made of long texts doesn't pile up."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the tokens' raw bytes, one after the other.  Null ids: no bytes; an unknown id raises."""
    df = without(df, out)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, shared.value.splitlines()) if a)
        size = np.zeros(rows[-1][0] + 1, np.int64)
        for i, token in rows:
            size[i] = len(token)
        first = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(token for _, token in rows), np.uint8)
        for batch in batches:
            for part in slices(batch, ids, 256):
                lists = part.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or not size[flat].all()):
                    raise ValueError("an id that the vocabulary does not have")
                long = size[flat]
                ends = np.cumsum(long)
                data = blob[np.repeat(first[flat] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
                per_row = np.array([len(x) if x is not None else 0 for x in (lists[i].values if lists[i].is_valid else None for i in range(len(lists)))], np.int64)
                edge = np.r_[0, ends][np.r_[0, np.cumsum(per_row)]]
                yield with_column(part, out, pa.array([data[a:b] for a, b in zip(edge, edge[1:])], pa.binary()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))
