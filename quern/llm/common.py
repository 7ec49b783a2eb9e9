"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z only.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` folds every letter, so it stands for this rule only where a text
    is pure ASCII; such texts take its vectorised path, all others ``translate``.
    """
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a folder
    of our own set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), "quern-checkpoints")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under names of our own, so that no extra column can clash."""
    return df.select(*(df[source].alias(name) for name, source in columns.items()))


def join_on_hidden_key(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join where ``right`` holds each key once and ``left`` may hold a hot key.

    ``right`` usually comes out of an aggregation on the same key. Joined as it
    is, its partitioning would be reused and adaptive execution could not split
    the hot partition of ``left``. An expression over the key hides that
    partitioning: both sides get an ordinary exchange, which skew-join handling
    splits, so a key with a third of all rows spreads over many tasks.
    """
    out = right.withColumn("_join_key", F.struct(F.lit(1).alias("a"), F.col(key).alias("b"))).drop(key)
    mine = left.withColumn("_join_key", F.struct(F.lit(1).alias("a"), F.col(key).alias("b")))
    return mine.join(out, "_join_key", how).drop("_join_key")
