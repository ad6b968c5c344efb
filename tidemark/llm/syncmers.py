"""Document fingerprints from closed syncmers, in DataFrame operations only.

Tokens are runs of at most TOKEN characters that are not ASCII white space.  A k-mer of K tokens is an anchor if the
smallest hash among its substrings of S tokens is the first or the last one; that depends on the k-mer alone, so an
edit elsewhere moves no anchor.  A fingerprint is all anchors of the whole text with their positions.

Two fingerprints are compared by position: an anchor counts for the first place that it has, equal anchors are matched,
and a match holds if the one before it or behind it in the first text is shifted as far, give or take SLACK tokens (or
if there is no other match).  So passages count wherever they were moved to, and stray equal anchors do not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, unused, without

TOKEN, K, S, SLACK = 16, 5, 2, 16


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often make names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"), F.lit(0))


def _anchor(h: Column, i: Column) -> Column:
    """The hash of the k-mer of five tokens at i, null if it is no closed syncmer; h: hashes of two tokens each."""
    at = lambda j: F.get(h, i + j)
    return F.when(F.least(at(0), at(3)) <= F.least(at(1), at(2)), F.xxhash64(at(0), at(2), at(3)))


def add_anchors(df: DataFrame, text: str, out: str, positions: bool = False) -> DataFrame:
    """Add ``out``: the hashes of the text's anchors (array<long>), or with positions (pos, hash) structs.

    pos is the number of the anchor's first token.  A text with tokens but without a closed syncmer (all of 1 to K-1
    tokens, some of few more) has one anchor, of all its tokens; a null text, or one without tokens, has none.
    """
    df = without(df, out) if out != text else df
    keep = [c for c in df.columns if c != out]
    w_, h_, a_ = (unused(df, x) for x in ("tokens", "hashes", "anchors"))
    split = df.withColumn(w_, tokens(text_of(text)))
    hashed = split.withColumn(h_, F.transform(F.slice(w_, F.lit(1), F.greatest(F.size(w_) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(w_, i + 1))))
    last = F.size(h_) - (K - S + 1)
    index = F.sequence(F.lit(0), last)
    few = F.when(F.size(w_) > 0, F.array(F.xxhash64(F.array_join(w_, " "))))
    if positions:
        many = F.filter(F.transform(index, lambda i: F.struct(i.alias("pos"), _anchor(F.col(h_), i).alias("hash"))), lambda a: a["hash"].isNotNull())
        kind, few = "array<struct<pos:int,hash:bigint>>", F.transform(few, lambda x: F.struct(F.lit(0).alias("pos"), x.alias("hash")))
    else:
        many, kind = F.array_compact(F.transform(index, lambda i: _anchor(F.col(h_), i))), "array<bigint>"
    found = hashed.withColumn(a_, F.when(last >= 0, many))
    return found.select(*(F.col(f"`{c}`") for c in keep), F.when(F.size(a_) > 0, F.col(a_)).otherwise(F.coalesce(few, F.array().cast(kind))).alias(out))


def firsts(anchors: Column, side: int) -> Column:
    """Distinct anchors (hash, side, pos) by hash, each at its first position."""
    marked = F.transform(anchors, lambda a: F.struct(a["hash"].alias("hash"), F.lit(side).alias("side"), a["pos"].alias("pos")))
    return let(F.sort_array(marked), lambda every: F.filter(every, lambda a, i: (i == 0) | (F.get(every, i - 1)["hash"] != a["hash"])))


def matches(a: Column, b: Column) -> Column:
    """Number of anchors that firsts(.., 0) and firsts(.., 1) of two texts share at places that agree."""
    pair = lambda every, x, i: F.struct(x["pos"].alias("pos"), (F.get(every, i + 1)["pos"] - x["pos"]).alias("shift"))
    both = lambda every: F.transform(every, lambda x, i: F.when((x["side"] == 0) & (F.get(every, i + 1)["hash"] == x["hash"]), pair(every, x, i)))
    met = let(F.sort_array(F.concat(a, b)), lambda every: F.sort_array(F.array_compact(both(every))))
    near = lambda m, x, i: F.coalesce(F.abs(F.get(m, i)["shift"] - x["shift"]) <= SLACK, F.lit(False))
    return let(met, lambda m: F.size(F.filter(m, lambda x, i: (F.size(m) == 1) | near(m, x, i - 1) | near(m, x, i + 1))))


def likeness(a: Column, b: Column) -> Column:
    """Share (0 to 1) of both texts' distinct anchors that match; 1 if neither has any.  a, b: see matches."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * matches(a, b) / (F.size(a) + F.size(b))))


def digest(anchors: Column) -> Column:
    """32 hexadecimal digits for all anchors and positions of a text; empty if there are none."""
    word = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.when(F.size(anchors) > 0, F.concat(word(anchors["hash"], anchors["pos"]), word(anchors["pos"], anchors["hash"]))).otherwise("")


def bucket_of(id: Column, bounds: list) -> Column:
    """Number of bounds not above id (null: 0); bounds are searched in two steps of about their root."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*map(F.lit, bounds))
    coarse = F.array(*(F.lit(b) for b in bounds[step - 1 :: step]))
    head = F.size(F.filter(coarse, lambda b: b <= id)) * step
    return F.when(id.isNull(), 0).otherwise(head + F.size(F.filter(F.slice(every, head + 1, F.lit(step)), lambda b: b <= id)))


def with_next(df: DataFrame, id: str = "doc_id", text: str = "text", parts: int | None = None, also: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, text, next_text): each document and the next one by id; after the last comes the first.

    Null ids come first, rows of one id count by a hash of their text.  Rows go once to the range of ids that they are
    in (``parts`` ranges, from quantiles of the ids), and the first row of each range goes to the range before as well,
    as a ghost behind its last row.  An id that has more rows than two ranges should is split into ranges of its texts'
    hashes.  Texts are read once; what is known before comes from the ids.  ``also`` may add a column ``own`` to
    (id, t), once per row; it comes back as ``own`` and ``next_own``.
    """
    spark = df.sparkSession
    parts = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id).alias("id"), text_of(text).alias("t"))
    total = docs.count()
    # At most parts / 2 rows: each of these ids holds more than 2 / parts of all rows.
    heavy = docs.groupBy("id").count().where(F.col("count") > 2 * total / parts).collect() if parts > 1 else []
    bounds = set(map(int, docs.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else set()
    bounds |= {r["id"] + d for r in heavy if r["id"] is not None for d in (0, 1)}
    pieces = F.coalesce(*(F.when(F.col("id").eqNullSafe(F.lit(r["id"])), -(-r["count"] * parts // total)) for r in heavy), F.lit(1))
    h = F.xxhash64("t")
    place = F.floor((F.shiftrightunsigned(h, 32) * pieces) / (1 << 32)) if heavy else F.lit(0)
    dealt = docs.withColumn("b", F.when(F.col("id").isNull(), 0).otherwise(bucket_of(F.col("id"), sorted(bounds)) + 1).cast("long") * (parts + 1) + place)
    # One row a range from here: ranges are at most as many as bounds and pieces.
    heads = dealt.groupBy("b").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", (F.shiftrightunsigned(h, 32) if heavy else F.lit(0)).alias("h"))).alias("x"))
    order = Window.partitionBy().orderBy("b")
    heads = heads.select("b", F.col("x.id").alias("head"), F.col("x.h").alias("head_h"), F.coalesce(F.lag("b").over(order), F.max("b").over(Window.partitionBy())).alias("before"))
    is_head = F.col("id").eqNullSafe(F.col("head")) & ((F.shiftrightunsigned(h, 32) == F.col("head_h")) if heavy else F.lit(True))
    copies = F.array_compact(F.array(F.struct("b", F.lit(False).alias("ghost")), F.when(is_head, F.struct(F.col("before").alias("b"), F.lit(True).alias("ghost")))))
    sent = dealt.join(F.broadcast(heads), "b").select("id", "t", F.explode(copies).alias("to")).select("to.*", "id", "t")
    by = ["b", "ghost", F.col("id").asc_nulls_first(), F.shiftrightunsigned(F.xxhash64("t"), 32), "t"]
    sorted_rows = sent.repartition("b").sortWithinPartitions(*by)
    full = also(sorted_rows) if also else sorted_rows.withColumn("own", F.lit(0))
    w = Window.partitionBy("b").orderBy(*by[1:])
    lead = full.withColumn("n", F.lead(F.struct("t", "own")).over(w)).where("not ghost")
    return lead.select(F.col("id").alias(id), F.col("t").alias(text), "own", F.col("n.t").alias("next_text"), F.col("n.own").alias("next_own"))


def fingerprint_edits(df: DataFrame, id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to that and to the next document's.

    The edited text has the last floor(n/4) code points replaced by the first as many (or all) of the next document.
    ``anchors`` and ``edited_anchors`` are the fingerprints in full, (pos, hash) structs; ``fingerprint`` and
    ``edited_fingerprint`` their digests.  A null text is empty; equal texts have equal fingerprints, the empty one's is
    ``""``; an empty table gives no rows.
    """
    pairs = with_next(df, id, text, parts, lambda rows: add_anchors(rows, "t", "own", positions=True))
    q = F.floor(F.length(text) / 4).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), F.length(text) - q), F.substr("next_text", F.lit(1), q))
    changed = add_anchors(pairs.select(id, F.length(text).cast("long").alias("n_chars"), F.col("own").alias("anchors"), "next_own", edited.alias("edited")), "edited", "edited_anchors", positions=True)
    told = changed.select(id, "n_chars", "edited", "anchors", "edited_anchors", firsts(F.col("anchors"), 0).alias("_a"), firsts(F.col("next_own"), 1).alias("_n"), firsts(F.col("edited_anchors"), 1).alias("_e"))
    return told.select(id, "n_chars", "edited", "anchors", "edited_anchors", digest(F.col("anchors")).alias("fingerprint"), digest(F.col("edited_anchors")).alias("edited_fingerprint"), likeness(F.col("_a"), F.col("_e")).alias("near_edited"), likeness(F.col("_a"), F.col("_n")).alias("near_next"))
