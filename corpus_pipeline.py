"""A training corpus from raw documents: five stages, each one operator, each on all that the one before kept.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, nearcopies, pii, toxicity
from tidemark.llm.common import count_words, cut, table, text_of, unused
from tidemark.llm.queries import pseudonym_key, vocabulary

#: Documents whose score is at least this are rejected.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, scores below TOXIC."""
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = unused(docs, "toxicity"), unused(docs, "toxic_spans")
    return toxicity.score(docs, weights, out=out).where(F.col(out[0]) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Near copies have at least 0.8 of their five-word shingles in common; every link is checked on the shingle sets.
    Candidates come from six SimHashes of a text's distinct words with 4 bits allowed (see README for their recall).
    """
    return nearcopies.keep_one(docs).select(*docs.columns)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by pseudonyms; n_chars follows the text."""
    count = unused(docs, "replaced")
    out = pii.pseudonymise(docs, pseudonym_key(spark), count=count)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length(text_of()).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken (none, one or two times).

    How often follows from id, source and size, so rows of one id in two sources or of two sizes are told apart.
    """
    id, source, size, n, copy = (unused(docs, f"mix_{c}") for c in ("id", "source", "size", "copies", "copy"))
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias(id), F.col("source").alias(source), F.col("size").alias(size)).agg(F.max("copies").cast("int").alias(n)).where(F.col(n) > 0)
    same = F.col("doc_id").eqNullSafe(F.col(id)) & F.col("source").eqNullSafe(F.col(source)) & (count_words(text_of()) == F.col(size))
    return docs.join(copies, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    ranks, pattern = vocabulary()
    out = bpe.encode(docs, ranks, pattern, keep=("doc_id", "source"))
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", reject_toxic), ("near copies", drop_near_copies), ("personal data", hide_personal), ("mix", mix_sources), ("tokens", tokenise)]

#: SQL has neither the trained model nor the hashes; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i < len(STAGES) - 1 else docs
    return docs
