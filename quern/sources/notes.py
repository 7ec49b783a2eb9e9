"""Notes and cards as DataFrames.

A note is (note_id, fields array<struct<name,value>>, tags, decks, note_type, card_ids,
title, modified, guid). Field order is meaningful, so fields are an array, not a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import plain_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_notes(docs: DataFrame) -> DataFrame:
    """One note per document: one field Text, tags language and source, deck lang::source."""
    return docs.select(
        (F.col("doc_id") + 1).alias("note_id"),
        F.array(F.struct(F.lit("Text").alias("name"), F.coalesce("text", F.lit("")).alias("value"))).alias("fields"),
        F.array_compact(F.array("lang", "source")).alias("tags"),
        F.array(F.concat_ws("::", "lang", "source")).alias("decks"),
        F.col("lang").alias("note_type"),
        F.array(F.col("doc_id") + 1).alias("card_ids"),
        F.lit(None).cast("string").alias("title"),
    )


def home_deck(deck: Column, original: Column) -> Column:
    """The original deck of a card in a filtered deck, else its deck, else 0."""
    return F.when(original > 0, original).when(deck > 0, deck).otherwise(0).cast("bigint")


def snapshot(notes: DataFrame, cards: DataFrame, decks: DataFrame, models: DataFrame) -> DataFrame:
    """Notes with their cards, deck names, note type and named fields.

    ``notes(id, guid, mid, mod, tags, flds)`` with fields joined by \\x1f and tags by
    blanks; ``cards(id, nid, did, odid)``; ``decks(id, name)``; ``models(id, name,
    field_names)``. Ids that are not positive are dropped; unnamed fields become
    ``Field n``. The title is the first raw field.
    """
    mine = cards.where("id > 0 and nid > 0").select("id", "nid", home_deck(F.col("did"), F.col("odid")).alias("deck_id"))
    named = mine.join(decks.select(F.col("id").alias("deck_id"), F.col("name").alias("deck")), "deck_id", "left")
    per_note = named.groupBy(F.col("nid").alias("note_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", "deck"))), lambda c: c["id"]).alias("card_ids"),
        F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("id", "deck"))), lambda c: c["deck"]), lambda d: d.isNotNull() & (F.trim(d) != ""))).alias("decks"),
    )
    models = models.select(F.col("id").alias("mid"), F.col("name").alias("note_type"), "field_names")
    values = F.split("flds", "\x1f")
    fields = F.transform(values, lambda v, i: F.struct(F.coalesce(F.get("field_names", i), F.concat(F.lit("Field "), (i + 1).cast("string"))).alias("name"), v.alias("value")))
    return (
        notes.where("id > 0").join(models, "mid", "left").withColumnRenamed("id", "note_id").join(per_note, "note_id", "left")
        .select("note_id", "guid", fields.alias("fields"), F.array_distinct(F.filter(F.split(F.trim("tags"), r"\s+"), lambda t: t != "")).alias("tags"), F.coalesce("decks", F.array().cast("array<string>")).alias("decks"), "note_type", F.coalesce("card_ids", F.array().cast("array<bigint>")).alias("card_ids"), F.get(values, F.lit(0)).alias("title"), F.col("mod").alias("modified"))
    )


def only_ids(rows: DataFrame, ids: DataFrame, key: str = "note_id") -> DataFrame:
    """Rows whose key is asked for; missing ones are left to the caller as deletions."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def bounded(ids: list[int], most: int = 250) -> list[int]:
    """Unique positive ids in first-seen order; more than ``most`` is an error."""
    out = list(dict.fromkeys(int(i) for i in ids if int(i) > 0))
    if len(out) > most:
        raise ValueError(f"at most {most} notes in one batch, not {len(out)}")
    return out


def deck_catalog(decks: DataFrame, normal: DataFrame) -> DataFrame:
    """All decks once, marked ``filtered`` unless they are normal decks."""
    flags = normal.select(F.col("id").alias("_id")).distinct().withColumn("_normal", F.lit(True))
    return decks.groupBy("id").agg(F.min("name").alias("name")).join(flags, F.col("id") == F.col("_id"), "left").select("id", "name", F.col("_normal").isNull().alias("filtered"))


def current_deck(catalog: DataFrame, *candidates: int | None) -> int | None:
    """The first candidate (selected, last used, ..) that is in the catalog; else its normal deck of least id, else any."""
    asked = [int(c) for c in candidates if c]
    here = {r.id for r in catalog.where(F.col("id").isin(*asked)).select("id").collect()} if asked else set()
    chosen = next((c for c in asked if c in here), None)
    if chosen is None:
        row = catalog.orderBy("filtered", "id").first()
        chosen = row.id if row else None
    return chosen


def legacy_titles(notes: DataFrame) -> DataFrame:
    """Notes with the title of the older reader: their first field that is not empty once cleaned."""
    flat = notes.select("note_id", F.posexplode_outer("fields").alias("at", "field")).select("note_id", "at", plain_text(F.coalesce("field.value", F.lit(""))).alias("value"))
    first = flat.groupBy("note_id").agg(F.min_by("value", F.when(F.col("value") != "", F.col("at"))).alias("_title"))
    return notes.join(first, "note_id", "left").withColumn("title", F.coalesce("_title", F.lit(""))).drop("_title")


def notes_of_cards(cards: DataFrame) -> DataFrame:
    """Distinct notes of the cards that a card search found."""
    return cards.where("nid > 0").select(F.col("nid").alias("note_id")).distinct()


def cards_by_note(cards: DataFrame, order: str = "id") -> DataFrame:
    """Card ids of each note in the given order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("id").alias("id"))))
    return cards.groupBy("nid").agg(F.transform(pairs, lambda p: p["id"]).alias("card_ids"))


def card_state(flags: Column, queue: Column) -> Column:
    """struct(flag 0-7, suspended, buried) of a card's raw flags and queue."""
    return F.struct(F.coalesce(flags, F.lit(0)).bitwiseAND(7).cast("int").alias("flag"), F.coalesce(queue == -1, F.lit(False)).alias("suspended"), F.coalesce(queue.isin(-2, -3), F.lit(False)).alias("buried"))


def field_names(models: DataFrame) -> DataFrame:
    """Field names over all note types, one spelling per case-folded name."""
    named = models.select(F.posexplode("field_names").alias("at", "name"), F.col("id").alias("model"))
    first = F.min_by("name", F.struct("model", "at"))
    return named.groupBy(F.lower("name").alias("key")).agg(first.alias("name"))
