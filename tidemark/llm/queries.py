"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, langid, merkle, mixing, pii, secrets, simhash, syncmers, toxicity, trie, urlfilter
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Where the key of pseudonyms comes from; the default is for tests and demonstrations, whose results anybody may repeat.
KEY_SETTING, DEMO_KEY = "spark.tidemark.pseudonym.key", "pseudonyms-1"


def pseudonym_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def vocabulary(name: str = VOCABULARY) -> tuple[bytes, str]:
    """A public vocabulary's rank file (read on the driver, shipped from there) and its pattern."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes(), public_tokenizers.PATTERN


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one that holds the template's own words; digests of what reads back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    turns = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text")) for i, role in enumerate(("user", "assistant"))))
    planted = spark.range(1).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.inline(turns))
    out = chat.format_chats(rows.unionByName(planted))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP1 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*(?:/?INST|/?SYS|/?ROLE|TEXT|SEAM)\]')) AS size,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS joined
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN joined THEN 6 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7 WHEN role = 'system' THEN 11
    ELSE 19 + length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*(?:/?INST|/?SYS|/?ROLE|TEXT|SEAM)\]')) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: 150% of all words, sources by weight 3, 1, 2, at most twice over.

    A source's copies for certain are the same for all its documents; documents of under 50 words have half the odds of
    the others to be taken once more.
    """
    odds = lambda size: F.when(size < 50, 0.5).otherwise(1.0)
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), odds=odds).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *(count(k) for k in ("assign", "access", "hex", "entropy")), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to."""
    ranks, pattern = vocabulary()
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern, keep=("doc_id",))
    back = bpe.decode(ids, ranks)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; learnt from the labelled ones that are not held out."""
    held = (F.crc32(F.col("doc_id").cast("string")) % 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    scored = toxicity.score(docs, weights, keep=("doc_id",))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("offending").alias("n_offending"), F.get("offending", F.lit(0))["start"].alias("first_start"), F.get("offending", F.lit(0))["end"].alias("first_end"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to each vector whose id 50 divides."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    done = syncmers.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.size("anchors").cast("long").alias("n_anchors"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges the URL of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "glob")


OP10 = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), r AS (
  SELECT *, '.' || host AS h FROM p
), j AS (
  SELECT *, CASE
    WHEN h LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
    WHEN h LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
    WHEN h LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
    WHEN h LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
    WHEN h LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM r
), g AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN h LIKE '%.%casino%' THEN '*.*casino*|*' WHEN h LIKE '%.%cheap-pills%' THEN '*.*cheap-pills*|*'
    WHEN h LIKE '%.%ads-track%' THEN '*.*ads-track*|*' WHEN h LIKE '%.%adult-%' THEN '*.*adult-*|*'
    WHEN h LIKE '%.%spam-%' THEN '*.*spam-*|*' WHEN h LIKE '%.%free-bets%' THEN '*.*free-bets*|*'
    WHEN path LIKE '%/login%' THEN '*|*/login*' WHEN path LIKE '%.exe' THEN '*|*.exe' END AS "glob"
  FROM j
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR "glob" IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, "glob"
FROM g
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS r FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM t WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT source, source_size, CASE WHEN lim <= level * w THEN lim ELSE least(lim, w * (SELECT arg_min(level, (lim / w, source)) FROM l WHERE NOT lim <= level * w)) END AS target FROM l
), x AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
), k AS (
  SELECT *, floor(least(2.0::DOUBLE, rate))::BIGINT AS base, least(2.0::DOUBLE, rate) - floor(least(2.0::DOUBLE, rate)) AS p FROM x
), o AS (
  SELECT *, CASE WHEN p > 0 THEN (((r + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (1 - (r + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)) / (p / (1 - p) * CASE WHEN size < 50 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) END AS place FROM k
), s AS (
  SELECT *, target - sum(base * size) OVER (PARTITION BY source) AS need,
    sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place, r, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o
), n AS (
  SELECT *, sum(size) OVER (PARTITION BY source, place, r, doc_id, size) AS words FROM s
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT *, (base + CASE WHEN p > 0 AND need > 0 AND upto - need <= need - (upto - words) THEN 1 ELSE 0 END)::BIGINT AS copies FROM n
)
"""


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; profiles learnt from documents that are not held out."""
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.train(docs, ~held)
    found = langid.predict(docs, profiles, keep=("doc_id",))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether it (or what was made of it) folds to the root."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(*map(F.col, FIELDS[:-1]), lower))
    done = merkle.manifest(table(spark, sf_dir, "documents").select(*FIELDS), merkle.leaf(*map(F.col, FIELDS)), other)
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    nodes = trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _crc32(decimal: str) -> str:
    """DuckDB has no crc32: bit by bit over the ASCII digits, unsigned; null for null."""
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(({decimal})::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {bits}), 4294967295)"


def _merkle_sql(levels: int = 12) -> str:
    """Levels of eight, written out; 12 are enough for 68 thousand million leaves."""
    said = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || {c} END"
    row = lambda text: "sha256(" + " || ".join(map(said, (*FIELDS[:-1], text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"l AS (SELECT doc_id, lang, {row('text')} AS leaf, CASE WHEN {_crc32('doc_id')} % 3 = 0 THEN {row(lower)} END AS other FROM documents)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w FROM l)",
        "a0 AS (SELECT lang, i, w, leaf AS d FROM n)", "s0 AS (SELECT *, i AS k, '' AS proof, coalesce(other, leaf) AS f FROM n)",
    ]

    def up(nodes: str, rows: str, group: str, x: int) -> list[str]:
        run = f"{group} IS NOT DISTINCT FROM r.{group} AND" if group else ""
        by = f"{group}, " if group else ""
        return [
            f"{nodes}r{x} AS (SELECT {by}i // 8 AS i, any_value(w) AS w, list(d ORDER BY i) AS ds FROM {nodes}{x} GROUP BY {by}i // 8)",
            f"{nodes}{x + 1} AS (SELECT {by}i, (w + 7) // 8 AS w, CASE WHEN w > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {nodes}r{x})",
            f"{rows}{x + 1} AS (SELECT s.* REPLACE (s.k // 8 AS k, CASE WHEN r.w > 1 THEN proof || array_to_string(ds[:k % 8], '') || array_to_string(ds[k % 8 + 2:], '') ELSE proof END AS proof, CASE WHEN r.w > 1 THEN sha256(array_to_string(ds[:k % 8], '') || f || array_to_string(ds[k % 8 + 2:], '')) ELSE f END AS f) FROM {rows}{x} s JOIN {nodes}r{x} r ON {'s.' + run if run else ''} s.k // 8 = r.i)",
        ]

    for x in range(levels):
        ctes += up("a", "s", "lang", x)
    ctes.append(f"b0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS w, d FROM a{levels})")
    ctes.append(f"t0 AS (SELECT s.* REPLACE (b.i AS k), b.d AS subroot FROM s{levels} s JOIN b0 b ON s.lang IS NOT DISTINCT FROM b.lang)")
    for x in range(levels):
        ctes += up("b", "t", "", x)
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM t{levels}, b{levels}"


OP13 = f"""
WITH c AS (
  SELECT conv_id, list({{r: coalesce(role, ''), t: coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t, {_crc32('conv_id')} % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), b AS (
  SELECT c.conv_id, list_concat(coalesce(o.t, [])[:c.h], c.t[c.h + 1:]) AS t FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5
), p AS (
  SELECT conv_id, len(t) AS total, d, sha256(list_transform(t[:d], lambda x: [x.r, x.t])::VARCHAR || '/' || list_transform(t[:d], lambda x: [len(x.r), len(x.t)])::VARCHAR) AS k, strlen(t[d].t) AS n, t
  FROM b, unnest(range(0, len(t) + 1)) AS x(d)
), k AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(n), 0) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = d), '')) AS ends_sha256 FROM p GROUP BY k, d
), up AS (
  SELECT k.k, a.k AS above, a.d AS lvl FROM k JOIN p a ON a.conv_id = k.conv_id AND a.d <= k.d
), kids AS (
  SELECT above AS k, count(*) AS n_children FROM up JOIN k USING (k) WHERE lvl = d - 1 GROUP BY above
), sums AS (
  SELECT above AS k, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up JOIN k USING (k) LEFT JOIN kids USING (k) GROUP BY above
)
SELECT k.conv_id, k.d AS depth, par.conv_id AS parent_conv_id, k.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, k.ends_sha256
FROM k JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN up u ON u.k = k.k AND u.lvl = k.d - 1 LEFT JOIN k par ON par.k = u.above
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat, op2_pii, op3_mix, op4_secrets, op5_bpe, op6_toxicity, op7_simhash, op8_ann, op9_syncmers, op10_urls, op11_langid, op12_merkle, op13_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1, "op3_mix": OP3, "op10_urls": OP10, "op12_merkle": _merkle_sql(), "op13_trie": OP13}
