"""Rules over text and metadata.

Word lists are short and known when a query is planned, so each is a literal array in one projection over the texts: no
join, no shuffle.  Plain terms are looked for with ``contains``; phrases that have to stand alone by one pattern for all.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from . import vocabulary as V
from .registry import feed_ids, phrase_table

# --- phrases


def terms_in(text: Column, terms) -> Column:
    """Array of the terms that a text holds as plain substrings, in their order; case does not count in the text."""
    every = F.array(*map(F.lit, terms))
    return let(F.lower(text), lambda low: F.filter(every, lambda t: F.contains(low, t)))


def _any_of(words) -> str:
    """A pattern for any of the words, as a trie: the longest that fits at a place."""
    tails: dict[str, list[str]] = {}
    for w in sorted(words):
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    ways = [re.escape(c) + _any_of(t) for c, t in tails.items()]
    if "" in words:
        return f"(?:{'|'.join(ways)})?" if ways else ""
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def phrases_in(text: Column, table) -> Column:
    """Array of (phrase, value) of a table whose phrase (or its plural) a text holds, no letter or digit at either side.

    One pattern reads the text and finds the longest phrase at each place, however many there are; only phrases that begin
    one of these can be there as well, and only those are looked for on their own.
    """
    table = list(table)
    bounded = lambda p: rf"{p}s?(?![a-z0-9])"
    every = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(v).alias("value"), F.lit(rf"(?<![a-z0-9]){bounded(re.escape(p))}").alias("pattern")) for p, v in table))
    pattern = rf"[^a-z0-9](?={bounded(f'({_any_of([p for p, _ in table])})')})"  # what is before a phrase, as that is quick to find

    def among(low: Column, longest: Column) -> Column:
        begins = lambda e: F.exists(longest, lambda p: F.startswith(p, e["phrase"])) & F.rlike(low, e["pattern"])
        return F.filter(every, lambda e: F.array_contains(longest, e["phrase"]) | begins(e))

    found = lambda low: let(F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), low), F.lit(pattern), F.lit(1))), lambda longest: among(low, longest))
    return let(F.lower(text), found)


def split_entry_exit(text: Column) -> Column:
    """Struct (entry, exit): what is before the first exit marker, and the rest."""
    marker = rf"\b{_any_of(V.EXIT_WORDS)}\b"
    maybe = let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(w)) for w in sorted({w[:4] for w in V.EXIT_WORDS}))))  # far quicker than the pattern

    def cut(entry: Column) -> Column:
        return F.struct(F.coalesce(entry, text).alias("entry"), F.coalesce(F.substr(text, F.length(entry) + 1), F.lit("")).alias("exit"))

    return let(F.when(maybe & F.rlike(text, F.lit(f"(?i){marker}")), F.regexp_extract(text, rf"(?is)\A(.*?){marker}", 1)), cut)


def first_trigger(text: Column, table: tuple[tuple[str, str], ...], default: str) -> Column:
    """The primitive of the first phrase of a table that is in the text."""
    return F.coalesce(F.get(phrases_in(text, table), F.lit(0))["value"], F.lit(default))


def entry_primitive(text: Column) -> Column:
    return first_trigger(text, V.ENTRY_PHRASES, "TRIGGER_CROSS_ABOVE")


def exit_primitive(text: Column) -> Column:
    return first_trigger(text, V.EXIT_PHRASES, "TRIGGER_CROSS_BELOW")


def detect_indicators(text: Column, table: list[tuple[str, str]] | None = None) -> Column:
    """Array of feed ids that a text names, the longest phrase first.

    A phrase inside another one that was already found does not count, nor does a second feed of the same phrase.
    """
    firsts: dict[str, str] = {}
    for phrase, feed in phrase_table() if table is None else table:
        firsts.setdefault(phrase, feed)  # a later feed of the same phrase is inside an earlier one
    longer = lambda o, h: (F.length(o["phrase"]) > F.length(h["phrase"])) & F.contains(o["phrase"], h["phrase"])
    outer = let(phrases_in(text, firsts.items()), lambda hits: F.filter(hits, lambda h: ~F.exists(hits, lambda o: longer(o, h))))
    return F.array_distinct(F.transform(outer, lambda h: h["value"]))


def detect_timeframe(text: Column, fallback: Column | str) -> Column:
    """``15-minute`` as ``15m``; the fallback where no duration is named."""
    spans = F.regexp_extract_all(text, F.lit("(?=[0-9])" + V.DURATION), F.lit(0))
    units = F.create_map(*(F.lit(x) for pair in V.UNITS.items() for x in pair))
    part = lambda x, i: F.regexp_extract(x, V.DURATION, i)
    named = F.transform(spans, lambda x: F.concat(F.regexp_replace(part(x, 1), r"^0+(?=\d)", ""), F.try_element_at(units, F.lower(part(x, 2)))))
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.get(F.filter(named, lambda x: x.isNotNull()), F.lit(0)), fallback)


def risk_union(tags: Column) -> Column:
    """Distinct tags of an array of arrays, in the order of their priority."""
    seen = F.flatten(tags)
    return F.array_compact(F.array(*(F.when(F.array_contains(seen, t), t) for t in V.RISK_PRIORITY)))


def guard_filter(tags: Column) -> Column:
    """The filter of the tag that comes first; null without tags."""
    return F.coalesce(*(F.when(F.array_contains(F.flatten(tags), t), V.GUARDS[t]) for t in V.RISK_PRIORITY))


def secondary_signal(detected: Column, vocabulary: list[str] | None = None) -> Column:
    """The first feed of the vocabulary that was not detected."""
    return F.get(F.array_except(F.array(*map(F.lit, vocabulary or feed_ids())), detected), F.lit(0))


# --- data catalog


def check_catalog(requirements: DataFrame, catalog: DataFrame) -> DataFrame:
    """requirements with status (available, proxy, missing), asset_class as the catalog has it, proxy_source and note.

    The catalog is grouped by symbol and by (symbol, granularity) first, so each requirement meets one row of either;
    with several, the smallest asset class and row count.
    """
    by_symbol = catalog.groupBy(F.col("symbol").alias("s")).agg(F.min("asset_class").alias("known_class"), F.max((F.col("granularity") == "1m").cast("int")).alias("has_1m"))
    exact = catalog.groupBy(F.col("symbol").alias("s"), F.col("granularity").alias("g")).agg(F.min(F.struct("start_year", "has_l2_book", "has_order_flow")).alias("e"))
    req = requirements.withColumn("symbol", F.upper("symbol"))
    j = req.join(by_symbol, F.col("symbol") == F.col("s"), "left").drop("s").join(exact, (F.col("symbol") == F.col("s")) & (F.col("required_granularity") == F.col("g")), "left").drop("s", "g")
    s, g, e = F.col("symbol"), F.col("required_granularity"), F.col("e")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    late = F.col("start_year").isNotNull() & (e["start_year"] > F.col("start_year"))
    no_book, no_flow = F.col("requires_l2_book") & ~e["has_l2_book"], F.col("requires_order_flow") & ~e["has_order_flow"]
    cases = (
        (F.col("known_class").isNull(), "missing", say("symbol '", s, "' absent from data catalog")),
        (e.isNull(), "missing", say("no ", g, " data for '", s, "' in catalog")),
        (late, "missing", say("data for '", s, "' starts ", e["start_year"].cast("string"), ", later than required ", F.col("start_year").cast("string"))),
        (no_book & (F.col("has_1m") == 1), "proxy", say("no L2 book for '", s, "'; approved proxy ", V.L2_PROXY, " on 1m bars")),
        (no_book, "missing", say("L2 book demanded but not available for '", s, "', and no proxy exists in catalog")),
        (no_flow, "missing", say("order flow demanded but not available for '", s, "' (no approved proxy)")),
    )
    status, note = F.lit("available"), say("verified: ", s, " ", g, " in catalog from ", e["start_year"].cast("string"))
    for condition, verdict, text in reversed(cases):
        status, note = F.when(condition, verdict).otherwise(status), F.when(condition, text).otherwise(note)
    judged = j.withColumn("status", status).withColumn("note", note).withColumn("asset_class", F.coalesce("known_class", "asset_class"))
    return judged.withColumn("proxy_source", F.when(F.col("status") == "proxy", f"{V.L2_PROXY}:1m")).drop("known_class", "has_1m", "e")


def all_available(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.coalesce(F.bool_and(F.col("status") != "missing"), F.lit(True)).alias("all_available"))


def alternate_symbols(anchors: DataFrame, catalog: DataFrame) -> DataFrame:
    """anchors (anchor, timeframe) with alternate: a symbol with data of that timeframe first, then of another asset
    class, then by name; null if the catalog holds no other.

    What an anchor can get are the first two names of each asset class, of those with data of its timeframe and of all,
    so it meets one row for its timeframe and the one row for all: two names a class, however large the catalog is.
    """
    symbols = catalog.groupBy("symbol").agg(F.min("asset_class").alias("class"))
    kinds = catalog.select("symbol", F.col("granularity").alias("g")).distinct().unionByName(symbols.select("symbol", F.lit(None).cast("string").alias("g")))
    first = Window.partitionBy("g", "class").orderBy("symbol")
    best = kinds.join(symbols, "symbol").withColumn("n", F.row_number().over(first)).where("n <= 2").groupBy("g").agg(F.collect_list(F.struct("symbol", "class")).alias("best"))
    own = symbols.select(F.col("symbol").alias("anchor"), F.col("class").alias("own"))
    have, every = best.where("g is not null").select(F.col("g").alias("timeframe"), F.col("best").alias("have")), best.where("g is null").select(F.col("best").alias("every"))
    named = anchors.join(own, "anchor", "left").join(have, "timeframe", "left").join(F.broadcast(every), how="left")
    rank = lambda c, lacks: F.transform(F.filter(F.coalesce(c, F.array()), lambda x: x["symbol"] != F.col("anchor")), lambda x: F.struct(F.lit(lacks).alias("lacks"), (x["class"] == F.coalesce("own", F.lit(""))).alias("same"), x["symbol"].alias("symbol")))
    return named.select(*(F.col(c) for c in anchors.columns), F.array_min(F.concat(rank(F.col("have"), False), rank(F.col("every"), True)))["symbol"].alias("alternate"))


# --- feasibility


def audit_text(text: Column, granularities: Column | None = None) -> Column:
    """Struct of what a strategy text asks for: dependencies, models, hints, mappings, and the verdict of each check.

    granularities: array of the catalog's granularities; without them the platform's own table holds.  Terms count as
    plain substrings.
    """
    terms = dict.fromkeys([*V.PROVIDERS, *V.GRANULARITY_HINTS, *V.OPAQUE_MODELS, *V.COMPUTE_HINTS, *V.ANALOGS])
    label = lambda *c: F.struct(*c)

    def satisfied(name: str) -> Column:
        platform = F.lit(name in V.PLATFORM_GRANULARITIES)
        if granularities is None:
            return platform
        sources = [g for g, labels in V.CATALOG_LABELS.items() if name in labels]
        own = F.arrays_overlap(granularities, F.array(*map(F.lit, sources))) if sources else F.lit(False)
        return F.when(F.size(granularities) > 0, own).otherwise(platform)

    def asked(found: Column) -> Column:
        has = lambda term: F.array_contains(found, term)
        listed = lambda terms: F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(found, t))
        mapped = F.arrays_overlap(found, F.array(*map(F.lit, V.ANALOGS)))
        provider = lambda name, kind: F.when(has(name), label(F.lit(name).alias("name"), (F.lit("satisfied") if kind == "crypto" else F.when(mapped, "partial").otherwise("missing")).alias("status")))
        wanted = lambda hint, name: F.when(has(hint), label(F.lit(f"granularity:{name}").alias("name"), F.when(satisfied(name), "satisfied").otherwise("missing").alias("status")))
        return label(
            F.array_compact(F.array(*(provider(n, k) for n, k in V.PROVIDERS.items()), *(wanted(h, g) for h, g in V.GRANULARITY_HINTS.items()))).alias("dependencies"),
            listed(V.OPAQUE_MODELS).alias("models"), listed(V.COMPUTE_HINTS).alias("hints"),
            F.array_compact(F.array(*(F.when(has(c), label(F.lit(c).alias("tradfi"), F.lit(a).alias("crypto"), F.lit(w).alias("confidence"))) for c, (a, w) in V.ANALOGS.items()))).alias("mappings"),
        )

    def judged(x: Column) -> Column:
        status = lambda value: F.exists(x["dependencies"], lambda d: d["status"] == value)
        weak = F.exists(x["mappings"], lambda m: m["confidence"] < 0.7)
        return label(
            *(x[c].alias(c) for c in ("dependencies", "models", "hints", "mappings")), verdict(status("missing"), status("partial")).alias("hard_dependencies"),
            verdict(F.size(x["models"]) > 0, F.size(x["hints"]) > 0).alias("algorithmic_compute"), verdict(F.lit(False), weak).alias("domain_mapping"),
        )

    # Named in turn, so that the optimiser copies none of them into the columns made of it.
    return let(let(terms_in(F.coalesce(text, F.lit("")), terms), asked), judged)


def verdict(rejected: Column, review: Column) -> Column:
    return F.when(rejected, "REJECTED").when(review, "REQUIRES_HITL").otherwise("PASSED")


def audit(df: DataFrame, text: str = "text", out: str = "audit", granularities: Column | None = None, tables: Column | None = None) -> DataFrame:
    """df with the audit struct and ``status``, the worst of its checks; tables may name the verdict of a table check."""
    done = df.withColumn(out, audit_text(F.trim(text), granularities))
    checks = [F.col(out)[c] for c in ("hard_dependencies", "algorithmic_compute", "domain_mapping")] + ([] if tables is None else [tables])
    any_of = lambda value: F.array_contains(F.array(*checks), value)
    return done.withColumn("status", verdict(any_of("REJECTED"), any_of("REQUIRES_HITL")))


# --- symbols


def resolve_math(text: Column, last_first: bool = False) -> Column:
    """Struct (resolved, symbols) of a text with mathematical symbols; null if it has none.

    Inline LaTeX goes first: each such piece becomes the definition of the first symbol of the table in it.
    Then every symbol that is left is replaced.  Pieces are replaced in the order of the text, or the distinct ones from the
    last to the first; that matters only where pieces overlap.
    """
    pieces = F.regexp_extract_all(text, F.lit(V.INLINE_LATEX), F.lit(0))
    body = lambda p: F.regexp_extract(p, r"(?s)\A(?:\$(.*)\$|\\\((.*)\\\))\z", 1)
    inner = lambda p: F.concat(body(p), F.regexp_extract(p, r"(?s)\A\\\((.*)\\\)\z", 1))
    first = lambda p, value: F.coalesce(*(F.when(inner(p).contains(s), value(s, d)) for s, d in V.SYMBOLS.items()))
    known = F.transform(pieces, lambda p: F.struct(p.alias("raw"), first(p, lambda s, d: F.lit(d)).alias("definition"), first(p, lambda s, d: F.lit(s)).alias("symbol")))
    defined = F.filter(known, lambda k: k["definition"].isNotNull())
    replaced = F.aggregate(F.reverse(F.array_distinct(defined)) if last_first else defined, text, lambda acc, k: F.replace(acc, k["raw"], k["definition"]))
    used = [F.transform(known, lambda k: F.coalesce(k["symbol"], k["raw"]))]
    now = replaced
    state = F.struct(now.alias("t"), F.flatten(F.array(*used)).alias("used"))
    table = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(d).alias("d")) for s, d in V.SYMBOLS.items()))
    step = lambda acc, x: F.when(acc["t"].contains(x["s"]), F.struct(F.replace(acc["t"], x["s"], x["d"]).alias("t"), F.concat(acc["used"], F.array(x["s"])).alias("used"))).otherwise(acc)
    done = F.aggregate(table, state, step)
    return F.when(F.size(done["used"]) > 0, F.struct(F.trim(done["t"]).alias("resolved"), F.array_distinct(done["used"]).alias("symbols")))


# --- tables


def check_cell(value: Column, kind: str) -> Column:
    """What is wrong with a cell, null if nothing is.  Kinds: string, number, percent, range ([low, high])."""
    text = F.trim(value)
    number = lambda c: c.rlike(V.NUMBER)
    empty = F.when(text == "", "empty cell")
    quoted = lambda tail: F.concat(F.lit("'"), text, F.lit(tail))
    if kind == "number":
        wrong = F.when(~number(text), quoted("' is not a number"))
    elif kind == "percent":
        wrong = F.when(~number(F.trim(F.rtrim(text, F.lit("%")))), quoted("' is not a percent"))
    elif kind == "range":
        low, high = (F.regexp_extract(text, V.RANGE, i).try_cast("double") for i in (1, 2))
        wrong = F.when(~text.rlike(V.RANGE), quoted("' is not a [min, max] range")).when(low > high, F.concat(F.lit("range "), text, F.lit(": lower bound > upper bound")))
    else:
        wrong = F.lit(None).cast("string")
    return F.coalesce(empty, wrong)


#: Table layouts: header, and the kind of each column to check.
LAYOUTS = {"parameters": (("Param", "Value", "Bounds"), {"Param": "string", "Value": "number", "Bounds": "range"})}


def validate_tables(cells: DataFrame, layouts: dict = LAYOUTS, most: int = 20) -> DataFrame:
    """One row per table of cells (table_id, row, col, text), row 0 being the header: status fit, parse-error or orphan,
    rows, columns and the first errors.  Rows are gathered per table row, then per table: each row is checked under every
    layout, as its header comes to it only there.  Cells that are dealt by table_id already stay where they are."""
    rows = cells.groupBy("table_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("c")).select("table_id", "row", F.col("c")["text"].alias("c"))

    def wrong(header: tuple[str, ...], kinds: dict[str, str]) -> Column:
        found = []
        for name, kind in kinds.items():
            at = header.index(name)
            cell = F.get("c", F.lit(at))
            line = lambda *parts: F.concat(F.lit("row "), (F.col("row") + 1).cast("string"), *parts)
            # Null where the cell's own message is.
            found.append(F.when(F.size("c") <= at, line(F.lit(f": expected column '{name}', row truncated"))).otherwise(line(F.lit(f" col '{name}' ("), cell, F.lit("): "), check_cell(cell, kind))))
        return F.array_compact(F.array(*found))

    none = F.array().cast("array<string>")
    body, names = F.col("row") > 0, list(layouts)
    checked = rows.select("table_id", "row", F.when(F.col("row") == 0, F.transform("c", F.trim)).alias("header"), *(F.when(body, wrong(h, kinds)).alias(f"e{i}") for i, (h, kinds) in enumerate(layouts.values())))
    errors = lambda i: F.flatten(F.sort_array(F.collect_list(F.when(F.size(f"e{i}") > 0, F.struct("row", F.col(f"e{i}").alias("e")))))["e"]).alias(f"e{i}")
    all_of = checked.groupBy("table_id").agg(F.count_if(body).alias("rows"), F.max("header").alias("header"), *(errors(i) for i in range(len(names))))
    fits = lambda i: F.col("header") == F.array(*map(F.lit, layouts[names[i]][0]))
    errors_of = F.coalesce(*(F.when(fits(i), F.col(f"e{i}")) for i in range(len(names))), none)
    known = F.coalesce(*(F.when(fits(i), F.lit(True)) for i in range(len(names))), F.lit(False))
    status = F.when(F.col("header").isNull(), "parse-error").when(~known, "orphan").when(F.size(errors_of) > 0, "parse-error").otherwise("fit")
    note = F.when(F.col("header").isNull(), F.array(F.lit("empty/unreadable grid"))).when(~known, F.array(F.concat(F.lit("no schema matches headers "), F.array_join("header", ", ")))).otherwise(F.slice(errors_of, 1, most))
    return all_of.select("table_id", status.alias("status"), F.when(F.col("header").isNull(), 0).otherwise(F.col("rows")).cast("long").alias("rows"), F.when(F.col("header").isNull(), 0).otherwise(F.size("header")).alias("columns"), note.alias("errors"))


# --- documents


def join_chunks(chunks: DataFrame, budget: int = 12_000, doc: str = "doc_id", order: str = "chunk_id", text: str = "text") -> DataFrame:
    """The text of each document's chunks in order, cut off where it reaches the budget of characters."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = chunks.withColumn("_used", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).where(F.col("_used") < budget)
    part = F.substr(F.col(text), F.lit(1), (budget - F.col("_used")).cast("int"))
    return used.groupBy(doc).agg(F.array_join(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t"))))["t"], "").alias(text))


def read_chunks(spark, path: str, most: int = 400) -> DataFrame:
    """Markdown or HTML files as chunks (doc_id, chunk_id, heading, text, tokens): paragraphs under their last heading,
    packed to at most ``most`` words where a paragraph allows.  Expressions only."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("t"))
    return chunk_text(raw, "doc_id", "t", most)


def chunk_text(df: DataFrame, doc: str, text: str, most: int = 400) -> DataFrame:
    """(doc, chunk_id, heading, text, tokens) of marked-up texts; see read_chunks."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)<h([1-6])[^>]*>", "\n\n# "), r"(?i)</h[1-6]>|</?p[^>]*>|<br */?>|</(div|li|tr|ul|table|section|article)>", "\n\n")
    clean = F.regexp_replace(plain, r"<[^>]+>", " ")
    blocks = F.filter(F.transform(F.split(clean, r"\n\s*\n"), lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: b != "")
    heads = lambda b: b.rlike(r"\A#+\s")
    empty = F.struct(F.lit("").alias("heading"), F.array().cast("array<struct<heading:string,text:string,tokens:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        words = F.size(F.split(b, r"\s+"))
        last = F.try_element_at(acc["out"], F.lit(-1))
        joins = last.isNotNull() & (last["heading"] == acc["heading"]) & (last["tokens"] + words <= most)
        own = F.struct(acc["heading"].alias("heading"), F.when(joins, F.concat(last["text"], F.lit("\n"), b)).otherwise(b).alias("text"), F.when(joins, last["tokens"] + words).otherwise(words).alias("tokens"))
        kept = F.when(joins, F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0)))).otherwise(acc["out"])
        title = F.regexp_replace(b, r"\A#+\s+", "")
        return F.when(heads(b), F.struct(title.alias("heading"), acc["out"].alias("out"))).otherwise(F.struct(acc["heading"].alias("heading"), F.concat(kept, F.array(own)).alias("out")))

    chunks = df.select(doc, F.posexplode(F.aggregate(blocks, empty, step, lambda a: a["out"])).alias("chunk_id", "c"))
    return chunks.select(doc, "chunk_id", "c.heading", "c.text", "c.tokens")
