"""Joins whose strategy depends on a checked size, and joins against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast; a larger one is shuffled.
SMALL = 100_000


def is_small(df: DataFrame, most: int = SMALL) -> bool:
    return df.limit(most + 1).count() <= most


def join_small(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", most: int = SMALL) -> DataFrame:
    """``right`` is counted: broadcast while it is small, shuffled (and split where hot) beyond."""
    if is_small(right, most):
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


def join_on_hidden_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join where ``right`` holds each key once and ``left`` may hold a hot key.

    ``right`` is usually an aggregate by the same key. Its partitioning would be reused
    and adaptive execution could then not split the hot partition of ``left``; hidden in
    an expression, both sides get an exchange that it can split.
    """
    hidden = F.struct(F.lit(1).alias("a"), F.col(key).alias("b"))
    return left.withColumn("_hidden", hidden).join(right.withColumn("_hidden", hidden).drop(key), "_hidden", how).drop("_hidden")
