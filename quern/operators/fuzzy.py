"""Spelling correction and alias expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.joins import is_small
from quern.functions.distance import budget, damerau_udf, letter_mask
from quern.functions.text import tokenize

SUGGESTIONS = 5
#: Parts of the vocabulary of one word length, where tokens are too many to broadcast.
_PARTS = 16


def build_vocabulary(counts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``(term, frequency, trusted)``: words seen, and the words of aliases as trusted ones."""
    seen = counts.where(F.size(tokenize(F.col("term"))) == 1).groupBy("term").agg(F.max("frequency").alias("frequency"))
    if aliases is None:
        return seen.withColumn("trusted", F.lit(False))
    both = aliases.select(F.explode(F.array("alias", "canonical")).alias("name"))
    known = both.select(F.explode(tokenize(F.col("name"))).alias("term")).distinct().select("term", F.lit(1).cast("bigint").alias("frequency"), F.lit(True).alias("trusted"))
    every = seen.withColumn("trusted", F.lit(False)).unionByName(known)
    return every.groupBy("term").agg(F.max("frequency").alias("frequency"), F.max("trusted").alias("trusted"))


def candidates(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, term, budget)`` pairs that pass the length and letter tests.

    An equi-join on length; the letter masks then leave few pairs for the edit distance.
    Lengths are few, so no shuffle goes by them: the asked tokens are broadcast while they
    are few and the vocabulary stays where it lies. Many tokens meet it in sixteen copies
    of their own, dealt by the vocabulary's words.
    """
    q = tokens.select("token").distinct().withColumn("budget", budget(F.col("token"))).where("budget > 0").withColumn("mask", letter_mask(F.col("token")))
    n = F.char_length("token")
    q = q.select("token", "budget", "mask", F.explode(F.sequence(F.greatest(n - F.col("budget"), F.lit(1)), n + F.col("budget"))).alias("n"))
    v = vocabulary.select("term", "frequency", "trusted", F.char_length("term").alias("n"), letter_mask(F.col("term")).alias("term_mask"))
    if is_small(q):
        pairs = v.join(F.broadcast(q), "n")
    else:
        dealt = v.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(_PARTS)))
        pairs = dealt.join(q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1)).cast("array<bigint>"))), ["n", "part"])
    pairs = pairs.where(F.col("token") != F.col("term"))
    return pairs.where(F.bit_count(F.col("mask").bitwiseXOR(F.col("term_mask"))) <= 2 * F.col("budget")).select("token", "term", "budget", "frequency", "trusted")


def suggestions(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ranked suggestions: ``(token, rank, term, distance, confidence, frequency, trusted)``.

    A trusted token needs none. A token seen more than once takes a trusted term only, and
    only one that is four times as frequent.
    """
    own = vocabulary.select(F.col("term").alias("token"), F.col("frequency").alias("own"), F.col("trusted").alias("own_trusted"))
    near = candidates(tokens, vocabulary).withColumn("distance", damerau_udf("token", "term", "budget")).where("distance <= budget")
    near = near.join(own, "token", "left").where(~F.coalesce("own_trusted", F.lit(False)))
    near = near.where((F.coalesce("own", F.lit(0)) <= 1) | F.col("trusted") & (F.col("frequency") >= 4 * F.col("own")))
    alike = 1 - F.col("distance") / F.greatest(F.char_length("token"), F.char_length("term"))
    bonus = F.least(F.lit(0.035), F.log10(F.col("frequency") + 1) * 0.008)
    near = near.withColumn("confidence", F.least(F.lit(0.999), alike + bonus + F.when(F.col("trusted"), 0.012).otherwise(0.0)))
    w = Window.partitionBy("token").orderBy("distance", F.desc("trusted"), F.desc("confidence"), F.desc("frequency"), "term")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SUGGESTIONS).select("token", "rank", "term", "distance", "confidence", "frequency", "trusted", "own")


def corrections(found: DataFrame) -> DataFrame:
    """The best suggestion of each token, and whether it is applied by itself.

    ``(token, corrected, distance, confidence, automatic, alternatives)``.
    """
    picked = found.groupBy("token").agg(
        F.min_by(F.struct("term", "distance", "confidence", "frequency", "trusted"), "rank").alias("best"),
        F.min_by(F.when(F.col("rank") == 2, F.struct("distance", "confidence", "frequency")), F.when(F.col("rank") == 2, 0)).alias("second"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").between(2, 4), F.struct("rank", "term")))), lambda x: x["term"]).alias("alternatives"),
        F.max("own").alias("own"),
    )
    best, second, n = F.col("best"), F.col("second"), F.char_length("token")
    margin = F.when(second["distance"] == best["distance"], best["confidence"] - second["confidence"]).otherwise(1.0)
    near = (best["distance"] == 1) & (n >= 6) & ((margin >= 0.012) | (best["frequency"] >= F.coalesce(second["frequency"] * 5, F.lit(1))))
    far = (best["distance"] == 2) & (n >= 9) & (best["confidence"] >= 0.84) & (margin >= 0.02)
    own = F.coalesce("own", F.lit(0))
    seen_often = best["trusted"] & (best["distance"] == 1) & (best["frequency"] >= 4 * own) & (n >= 6)
    automatic = F.when(own > 1, seen_often).when((own == 1) & ~best["trusted"], False).otherwise(near | far)
    return picked.select("token", best["term"].alias("corrected"), best["distance"].alias("distance"), best["confidence"].alias("confidence"), automatic.alias("automatic"), "alternatives")


def expand_aliases(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(value, expanded, direction)``: all canonical names, and one-word aliases back."""
    v = values.select("value").distinct()
    ahead = v.join(aliases, v["value"] == aliases["alias"]).select("value", F.col("canonical").alias("expanded"), F.lit("alias_to_canonical").alias("direction"))
    back = v.join(aliases.where(F.size(tokenize(F.col("alias"))) <= 1), F.col("value") == F.col("canonical")).select("value", F.col("alias").alias("expanded"), F.lit("canonical_to_alias").alias("direction"))
    return ahead.unionByName(back).distinct()


def shared_ingredients(products: DataFrame) -> DataFrame:
    """Aliases from observed sets: ``products(alias, surface, item, ingredient)``.

    An item's ingredients are one set. An alias keeps the ingredients that all of its
    items share; where they share none it keeps its only set, if it has but one. The
    surface is the most frequent spelling, ties by spelling. ``(alias, surface, ingredient)``.
    """
    rows = products.where("alias <> '' and ingredient <> ''")
    items = rows.groupBy("alias", "item").agg(F.collect_set("ingredient").alias("set"))
    sets = items.select("alias", F.array_sort("set").alias("set")).distinct()
    wanted = sets.groupBy("alias").agg(F.count("*").alias("n"), F.first("set").alias("any"))
    shared = sets.select("alias", F.explode("set").alias("ingredient")).groupBy("alias", "ingredient").agg(F.count("*").alias("k")).join(wanted.select("alias", "n"), "alias").where("k = n").select("alias", "ingredient")
    spelled = rows.select("alias", "surface", "item").distinct().groupBy("alias", "surface").agg(F.count("*").alias("k"))
    surface = spelled.groupBy("alias").agg(F.min_by("surface", F.struct((-F.col("k")).alias("k"), "surface")).alias("surface"))
    return shared.join(surface, "alias").where("alias <> ingredient").select("alias", "surface", "ingredient")
