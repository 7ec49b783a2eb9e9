"""Change capture: a coalescing queue, snapshot diffs, last-event-wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Reason bits.
LEXICAL, SEMANTIC, VOCABULARY, CARD_METADATA, DELETED = 1, 2, 4, 8, 16
NOTE_CONTENT = LEXICAL | SEMANTIC | VOCABULARY

NOTE_COLUMNS = ("modified_seconds", "usn", "note_type_id", "fields_length", "tags_length", "field_checksum", "fields_digest", "tags_digest")


def coalesce_queue(changes: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """One row per note: reasons united, latest sequence and time, attempts from zero.

    ``changes(note_id, reasons, sequence, queued_at)``. Merging into ``pending`` keeps the
    attempts of notes that did not change.
    """
    rows = changes.select("note_id", "reasons", "sequence", "queued_at", F.lit(0).alias("attempts"), F.lit(1).alias("fresh")).where("note_id > 0 and reasons > 0")
    if pending is not None:
        rows = rows.unionByName(pending.select("note_id", "reasons", "sequence", "queued_at", "attempts", F.lit(0).alias("fresh")))
    return rows.groupBy("note_id").agg(
        F.bit_or("reasons").alias("reasons"), F.max("sequence").alias("sequence"), F.max_by("queued_at", "sequence").alias("queued_at"),
        F.when(F.max("fresh") == 1, 0).otherwise(F.max("attempts")).alias("attempts"),
    )


def pending(queue: DataFrame, limit: int | None = None) -> DataFrame:
    out = queue.orderBy("sequence", "note_id")
    return out if limit is None else out.limit(limit)


def attempted(queue: DataFrame, tried: DataFrame) -> DataFrame:
    """Attempts go up only where the sequence is still the one that was tried."""
    t = tried.select("note_id", F.col("sequence").alias("_s")).distinct()
    out = queue.join(t, (queue["note_id"] == t["note_id"]) & (queue["sequence"] == t["_s"]), "left").drop(t["note_id"])
    return out.withColumn("attempts", F.col("attempts") + F.col("_s").isNotNull().cast("int")).drop("_s")


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue after acknowledgements ``(note_id, sequence, reasons)``.

    One of an older sequence changes nothing. Null reasons clear the row; others clear
    their bits, and a row without reasons goes.
    """
    d = done.groupBy(F.col("note_id").alias("_id"), F.col("sequence").alias("_s")).agg(F.bit_or(F.coalesce("reasons", F.lit(-1))).alias("_r"))
    out = queue.join(d, (F.col("note_id") == F.col("_id")) & (F.col("sequence") == F.col("_s")), "left")
    left = F.col("reasons").bitwiseAND(F.bitwise_not(F.coalesce("_r", F.lit(0))))
    return out.withColumn("reasons", left).where("reasons <> 0").drop("_id", "_s", "_r")


def acknowledge_all(queue: DataFrame, done: DataFrame) -> tuple[DataFrame, bool]:
    """Remove every (note, sequence), or, if one of them is stale, nothing."""
    stale = done.join(queue, ["note_id", "sequence"], "left_anti").take(1)
    return (queue, False) if stale else (queue.join(done, ["note_id", "sequence"], "left_anti"), True)


def diff(current: DataFrame, saved: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, change, old columns as old_*)``: added, changed, deleted, unchanged.

    A row has changed if any column differs, null-safe. One full join on the keys.
    """
    a = current.select(*(F.col(k).alias(f"_a_{k}") for k in keys), *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("_new"))
    b = saved.select(*(F.col(k).alias(f"_b_{k}") for k in keys), *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("_old"))
    on = reduce(lambda x, y: x & y, (F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in keys))
    differs = reduce(lambda x, y: x | y, (~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}")) for c in columns))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(differs, "changed").otherwise("unchanged")
    return a.join(b, on, "full").select(*(F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys), change.alias("change"), *(f"new_{c}" for c in columns), *(f"old_{c}" for c in columns))


def note_diff(current: DataFrame, saved: DataFrame, columns=NOTE_COLUMNS, digests: tuple[str, ...] = ("fields_digest", "tags_digest")) -> DataFrame:
    """``(note_id, change)``; a missing digest counts as a change."""
    out = diff(current, saved, ["note_id"], list(columns))
    absent = reduce(lambda x, y: x | y, (F.col(f"{side}_{d}").isNull() for d in digests for side in ("new", "old")), F.lit(False))
    return out.select("note_id", F.when((F.col("change") == "unchanged") & absent, "changed").otherwise(F.col("change")).alias("change"))


def card_diff(current: DataFrame, saved: DataFrame) -> DataFrame:
    """``(card_id, change, new_note_id, new_home_deck_id, old_...)`` of (card_id, note_id, home_deck_id)."""
    return diff(current, saved, ["card_id"], ["note_id", "home_deck_id"])


def affected_owners(cards: DataFrame) -> DataFrame:
    """Notes of cards that changed: both owners of a moved card."""
    moved = cards.where("change <> 'unchanged'")
    return moved.select(F.col("new_note_id").alias("note_id")).union(moved.select("old_note_id")).where("note_id > 0").distinct()


def facet_diff(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(facet, object_id, signature) diffs; facet names are trimmed and folded."""
    fold = lambda df: df.select(F.lower(F.trim("facet")).alias("facet"), "object_id", "signature").where("facet <> '' and object_id > 0")
    return diff(fold(current), fold(saved), ["facet", "object_id"], ["signature"])


def fan_out(facets: DataFrame, members: DataFrame) -> DataFrame:
    """Notes of facets that changed; ``members(facet, object_id, note_id)``."""
    changed = facets.where("change <> 'unchanged'").select("facet", "object_id")
    return members.join(changed, ["facet", "object_id"], "left_semi").select("note_id").distinct()


def last_wins(events: DataFrame) -> DataFrame:
    """``events(note_id, sequence, deleted)``: the last state of each note; a deletion wins a tie."""
    last = F.max(F.struct("sequence", "deleted"))
    return events.groupBy("note_id").agg(last.alias("l")).select("note_id", F.col("l.sequence").alias("sequence"), F.when(F.col("l.deleted"), "delete").otherwise("upsert").alias("action"))


def fingerprint(**frames: tuple[DataFrame, dict]) -> str:
    """sha256 of global counts, sums and maxima of several tables, for a cheap gate."""
    import hashlib

    parts = []
    for name in sorted(frames):
        df, aggs = frames[name]
        row = df.agg(*(F.coalesce(agg, F.lit(0)).alias(a) for a, agg in aggs.items())).first()
        parts.append(name + ":" + "|".join(str(v) for v in row))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()
