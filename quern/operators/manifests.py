"""Manifests: compact signatures of notes, cards and facets, to find what changed.

A manifest says enough about a row to tell whether it changed, and holds none of its
text. Functions here are plain frames; ``journal`` stores them.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quern.sources.notes import home_deck

NOTE_MANIFEST = "note_id bigint, modified_seconds bigint, usn bigint, note_type_id bigint, fields_length bigint, tags_length bigint, field_checksum bigint, fields_digest binary, tags_digest binary"
CARD_MANIFEST = "card_id bigint, note_id bigint, home_deck_id bigint"
FACET_MANIFEST = "facet string, object_id bigint, signature string"
MOST_ROWS = 5000


@F.pandas_udf(BinaryType())
def _blake(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.blake2b((t or "").encode(), digest_size=16).digest())


def digest(text: Column) -> Column:
    """128 bits of BLAKE2b of a text; of a null as of an empty one."""
    return _blake(text)


def note_manifest(notes: DataFrame, digest=digest) -> DataFrame:
    """One signature a note of ``notes(id, mod, usn, mid, csum, flds, tags)``.

    Lengths are bytes of UTF-8; a null counts as 0 or as an empty text. ``digest`` is any
    function of a text column (a built-in one, such as ``unhex(md5)``, needs no Python).
    """
    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    return notes.select(
        F.col("id").cast("bigint").alias("note_id"), number("mod").alias("modified_seconds"), number("usn").alias("usn"), number("mid").alias("note_type_id"),
        F.coalesce(F.octet_length("flds"), F.lit(0)).cast("bigint").alias("fields_length"), F.coalesce(F.octet_length("tags"), F.lit(0)).cast("bigint").alias("tags_length"),
        number("csum").alias("field_checksum"), digest(F.col("flds")).alias("fields_digest"), digest(F.col("tags")).alias("tags_digest"),
    )


def card_manifest(cards: DataFrame) -> DataFrame:
    """``(card_id, note_id, home_deck_id)`` of ``cards(id, nid, did, odid)``."""
    return cards.select(F.col("id").cast("bigint").alias("card_id"), F.col("nid").cast("bigint").alias("note_id"), home_deck(F.col("did"), F.col("odid")).alias("home_deck_id"))


def page(rows: DataFrame, key: str, after: int = 0, limit: int = 500) -> DataFrame:
    """The next rows by key after one that was seen; at most ``MOST_ROWS``."""
    if limit <= 0:
        raise ValueError("a page has at least one row")
    return rows.where(F.col(key) > max(0, after)).orderBy(key).limit(min(limit, MOST_ROWS))


def for_notes(rows: DataFrame, wanted: DataFrame, order: str) -> DataFrame:
    """Rows of the notes asked for, in order; what is not there is left out."""
    ids = wanted.select(F.col("note_id").cast("bigint").alias("note_id")).where("note_id > 0").distinct()
    return rows.join(ids, "note_id", "left_semi").orderBy(order)


def owners_in_filtered_decks(cards: DataFrame) -> DataFrame:
    """Notes with a card that is away from its home deck."""
    return cards.where("odid > 0").select(F.col("nid").alias("note_id")).distinct()


def facets(decks: DataFrame, models: DataFrame) -> DataFrame:
    """Signatures of what notes refer to: a deck's name, a note type's name and fields as JSON."""
    named = F.concat(F.lit("["), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(","), F.to_json("field_names"), F.lit("]"))
    of_decks = decks.select(F.lit("deck").alias("facet"), F.col("id").cast("bigint").alias("object_id"), F.col("name").alias("signature"))
    return of_decks.unionByName(models.select(F.lit("notetype").alias("facet"), F.col("id").cast("bigint").alias("object_id"), named.alias("signature"))).where("object_id > 0")


# --- what a manifest must be --------------------------------------------------------


def _refuse(rows: DataFrame, bad: str, why: str) -> DataFrame:
    """Rows with a lazy check: the plan that reads them fails at the first bad row."""
    first = rows.columns[0]
    return rows.withColumn(first, F.when(F.expr(bad), F.raise_error(F.lit(why))).otherwise(F.col(first)))


def checked_notes(rows: DataFrame) -> DataFrame:
    return _refuse(rows, "coalesce(note_id, 0) <= 0 or coalesce(fields_length, 0) < 0 or coalesce(tags_length, 0) < 0", "a note manifest needs positive ids and lengths of zero or more")


def checked_cards(rows: DataFrame) -> DataFrame:
    return _refuse(rows, "coalesce(card_id, 0) <= 0 or coalesce(note_id, 0) <= 0 or coalesce(home_deck_id, 0) <= 0", "a card manifest needs positive ids")


def checked_facets(rows: DataFrame) -> DataFrame:
    """Facet names are trimmed and folded; an empty one is an error."""
    folded = rows.select(F.lower(F.trim("facet")).alias("facet"), "object_id", "signature")
    return _refuse(folded, "coalesce(facet, '') = '' or coalesce(object_id, 0) <= 0", "a facet needs a name and a positive id")


# --- stored and incoming rows -------------------------------------------------------


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, those of incoming keys replaced. Incoming keys that repeat keep their last row by all columns."""
    other = [c for c in stored.columns if c not in keys]
    fresh = incoming.groupBy(*keys).agg(F.max(F.struct(*other)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in other)).select(stored.columns)
    return without(stored, fresh, keys).unionByName(fresh)


def without(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(keys).distinct(), keys, "left_anti").select(stored.columns)


def replaced_for_owners(stored: DataFrame, owners: DataFrame, incoming: DataFrame) -> DataFrame:
    """A card manifest with all cards of some notes replaced, so that removed cards go.

    Incoming rows must belong to these notes; one of another note is an error.
    """
    mine = owners.select("note_id").distinct().withColumn("_owned", F.lit(True))
    known = incoming.join(mine, "note_id", "left")
    known = known.withColumn("card_id", F.when(F.col("_owned").isNull(), F.raise_error(F.lit("a card belongs to none of the notes asked for"))).otherwise(F.col("card_id")))
    return without(stored, owners, ["note_id"]).unionByName(checked_cards(known.select(stored.columns)))


# --- does an index match the collection? --------------------------------------------


def mismatches(documents: DataFrame, notes: DataFrame, cards: DataFrame, facets: DataFrame, digest=digest) -> DataFrame:
    """``(note_id)`` of manifest notes that stored documents do not prove to be the same.

    ``documents(note_id, fields, tags, decks, note_type, card_ids)``. A note's raw fields
    and tags are put together again and digested; its note type's name and fields, its
    cards and the names of their decks must agree as well. A missing document is a
    mismatch, and so is a note type without a readable facet.
    """
    names = F.transform("fields", lambda f: f["name"])
    raw = F.array_join(F.transform("fields", lambda f: F.coalesce(f["value"], F.lit(""))), "\x1f")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" "), F.array_join("tags", " "), F.lit(" "))).otherwise("")
    kept = documents.select(
        "note_id", digest(raw).alias("_fields"), digest(tags).alias("_tags"), "note_type", names.alias("_names"),
        F.array_sort("card_ids").alias("_cards"), F.array_sort(F.array_distinct("decks")).alias("_decks"),
    )
    kinds = facets.where("facet = 'notetype'").select(F.col("object_id").alias("note_type_id"), F.from_json("signature", "array<string>").alias("_raw"))
    kinds = kinds.select("note_type_id", F.get("_raw", F.lit(0)).alias("_kind"), F.from_json(F.get("_raw", F.lit(1)), "array<string>").alias("_kind_fields"))
    decks = facets.where("facet = 'deck'").select(F.col("object_id").alias("home_deck_id"), F.col("signature").alias("_deck"))
    scope = cards.join(decks, "home_deck_id", "left").groupBy("note_id").agg(
        F.array_sort(F.collect_list("card_id")).alias("_want_cards"), F.array_sort(F.collect_set(F.when(F.col("_deck") != "", F.col("_deck")))).alias("_want_decks")
    )
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    rows = notes.join(kept, "note_id", "left").join(kinds, "note_type_id", "left").join(scope, "note_id", "left")
    same = (
        (F.col("_fields") == F.col("fields_digest")) & (F.col("_tags") == F.col("tags_digest")) & (F.col("note_type") == F.col("_kind")) & (F.col("_names") == F.col("_kind_fields"))
        & (F.col("_cards") == F.coalesce("_want_cards", none[0])) & (F.col("_decks") == F.coalesce("_want_decks", none[1]))
    )
    return rows.where(~F.coalesce(same, F.lit(False))).select("note_id").distinct()
