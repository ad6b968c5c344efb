"""What the operators of this subpackage share: reading, cutting lineage, text constants."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (the six characters that bytes.split() splits at).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably (in the shared checkpoint folder) and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session in which it is unset, as in tests,
    gets a temporary one; on a cluster a missing setting is an error, because executors do not share local folders.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add: an input column of the same name is replaced."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet: the name, with as many _ before it as that takes."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def text_of(name: str = "text") -> Column:
    """The text column; a null text is an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text: Column) -> Column:
    """Number of words (long) in a text that is not null."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, SPACE, -1))).cast("long")
