"""Connected components of a link table, by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every
round points each node's neighbours at the least neighbour. Rounds grow with the
logarithm of the longest path, not with its length. Each round is two
aggregations and two joins; nothing is gathered on the driver but one count and
one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, join_on_hidden_key


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = join_on_hidden_key(both, least, "u", "inner")
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = join_on_hidden_key(down, least, "u", "inner")
    linked = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` to ``(node, component)``, the component being its least node.

    The least node of a component and nodes without a link to another node are not
    returned: they stand for themselves. Self links, repeated
    links and null ends are ignored; an empty table gives an empty result.
    """
    edges = links.select("u", "v").where("u is not null and v is not null and u <> v")
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        edges = checkpointed(_small_star(_large_star(edges)).distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
    raise RuntimeError("components did not settle; raise max_rounds")
