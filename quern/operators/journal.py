"""The journal of a collection: queue, manifests, audits, and reconciling an index with it.

All state lies in versioned tables and keys of one root; every method that changes
something is one commit, so a crash leaves the state before it or after it. An audit
compares the collection's manifests with the saved ones and turns what changed into
queued notes in the same commit that saves the new manifests: work can be done twice
but is never lost.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import changes, manifests
from quern.operators.versions import Versions
from quern.operators.writer import IndexWriter

QUEUE = "note_id bigint, reasons int, sequence bigint, queued_at double, attempts int"
TABLES = {"note_manifest": (manifests.NOTE_MANIFEST, ["note_id"], manifests.checked_notes), "card_manifest": (manifests.CARD_MANIFEST, ["card_id"], manifests.checked_cards), "facet_manifest": (manifests.FACET_MANIFEST, ["facet", "object_id"], manifests.checked_facets)}
ALL_OF_DELETED = changes.DELETED | changes.LEXICAL | changes.SEMANTIC | changes.VOCABULARY


@dataclass(frozen=True)
class Inventory:
    """Manifests of a collection as it is, and a fingerprint of all of it."""

    notes: DataFrame
    cards: DataFrame
    facets: DataFrame
    fingerprint: str
    #: Notes with cards away from their home decks; an old index may hold such a deck's name.
    filtered_owners: DataFrame | None = None


class Source(Protocol):
    """What reconciling reads of a collection."""

    def inventory(self) -> Inventory: ...

    def notes(self, wanted: DataFrame | None = None) -> DataFrame:
        """Whole notes, of the ids asked for or all."""


class Journal:
    def __init__(self, versions: Versions):
        self.versions, self.spark = versions, versions.spark

    # -- keys and sequences ------------------------------------------------------------

    def get(self, key: str, default=None):
        return self.versions.key(key, default)

    def set(self, key: str, value) -> None:
        self.versions.publish({}, False, {key: value})

    def delete(self, key: str) -> bool:
        there = self.get(key) is not None
        if there:
            self.versions.publish({}, False, {key: None})
        return there

    def _next(self) -> int:
        """The next sequence number; the commit that uses it must save it."""
        return int(self.get("sequence", 0)) + 1

    # -- queue -------------------------------------------------------------------------

    def queue(self) -> DataFrame:
        return self.versions.read_or_empty("queue", QUEUE)

    def _queued(self, parts: list[tuple[DataFrame, int]], sequence: int) -> DataFrame:
        now = float(time.time())
        rows = [ids.select("note_id", F.lit(r).alias("reasons"), F.lit(sequence).cast("bigint").alias("sequence"), F.lit(now).alias("queued_at")).distinct() for ids, r in parts]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        return changes.coalesce_queue(every, self.queue()).select("note_id", F.col("reasons").cast("int").alias("reasons"), "sequence", "queued_at", F.col("attempts").cast("int").alias("attempts"))

    def enqueue(self, ids: DataFrame, reasons: int) -> int:
        """Queue notes for some reasons under a new sequence number, which is returned."""
        sequence = self._next()
        self.versions.publish({"queue": self._queued([(ids, reasons)], sequence)}, False, {"sequence": sequence})
        return sequence

    def pending(self, limit: int | None = None) -> DataFrame:
        return changes.pending(self.queue(), limit)

    def pending_count(self) -> int:
        return self.queue().count()

    def has_pending(self) -> bool:
        return not self.queue().isEmpty()

    def work(self) -> dict[str, bool]:
        """Whether there is queued work and an audit to do, without waiting for either."""
        return {"pending": self.has_pending(), "audit": self.audit_request() is not None}

    def mark_attempted(self, tried: DataFrame) -> None:
        self.versions.publish({"queue": changes.attempted(self.queue(), tried).select("note_id", "reasons", "sequence", "queued_at", "attempts")}, False)

    def acknowledge(self, done: DataFrame) -> None:
        """``done(note_id, sequence, reasons)``; see ``changes.acknowledge``."""
        self.versions.publish({"queue": changes.acknowledge(self.queue(), done).select("note_id", "reasons", "sequence", "queued_at", "attempts")}, False)

    def acknowledge_all(self, done: DataFrame) -> bool:
        left, settled = changes.acknowledge_all(self.queue(), done)
        if settled:
            self.versions.publish({"queue": left.select("note_id", "reasons", "sequence", "queued_at", "attempts")}, False)
        return settled

    # -- audits ------------------------------------------------------------------------

    def request_audit(self, reason: str = "unspecified") -> int:
        sequence = self._next()
        self.versions.publish({}, False, {"sequence": sequence, "audit": {"sequence": sequence, "reason": reason, "at": time.time()}})
        return sequence

    def audit_request(self) -> dict | None:
        return self.get("audit")

    def _audit_done(self, sequence: int, clear: tuple[str, ...] = ()) -> dict | None:
        """Keys to change when the audit of a sequence is done; None if a later one was asked for."""
        asked = self.audit_request()
        if asked is None or asked["sequence"] != sequence:
            return None
        return {"audit": None, "audit_completed": sequence, **dict.fromkeys(clear)}

    def complete_audit(self, sequence: int, clear: tuple[str, ...] = ()) -> bool:
        keys = self._audit_done(sequence, clear)
        if keys is not None:
            self.versions.publish({}, False, keys)
        return keys is not None

    # -- manifests ---------------------------------------------------------------------

    def manifest(self, name: str) -> DataFrame:
        return self.versions.read_or_empty(name, TABLES[name][0])

    def replace_manifest(self, name: str, rows: DataFrame) -> None:
        schema, keys, checked = TABLES[name]
        self.versions.publish({name: manifests.upserted(self.spark.createDataFrame([], schema), checked(rows), keys)}, False)

    def upsert_manifest(self, name: str, rows: DataFrame) -> None:
        _, keys, checked = TABLES[name]
        self.versions.publish({name: manifests.upserted(self.manifest(name), checked(rows), keys)}, False)

    def delete_manifest(self, name: str, gone: DataFrame) -> None:
        """Rows of the keys in ``gone`` go; cards may also go by ``note_id``."""
        keys = [k for k in TABLES[name][1] if k in gone.columns] or ["note_id"]
        self.versions.publish({name: manifests.without(self.manifest(name), gone, keys)}, False)

    def replace_cards_of(self, owners: DataFrame, rows: DataFrame) -> None:
        self.versions.publish({"card_manifest": manifests.replaced_for_owners(self.manifest("card_manifest"), owners, rows)}, False)

    # -- audit: what changed -----------------------------------------------------------

    def changed(self, found: Inventory, index: IndexWriter) -> tuple[DataFrame, DataFrame]:
        """``(note_id)`` of live notes to index again, and of notes that are gone.

        Without saved manifests an index of the same ids and fingerprint is verified note by
        note; any other index counts as unknown, so that all notes are read again.
        """
        here = found.notes.select("note_id")
        if self.get("manifests_saved"):
            diff = changes.note_diff(found.notes, self.manifest("note_manifest"))
            cards = changes.affected_owners(changes.card_diff(found.cards, self.manifest("card_manifest")))
            facets = changes.facet_diff(found.facets, self.manifest("facet_manifest")).where("change <> 'unchanged'")
            of_type = self.manifest("note_manifest").select("note_id", "note_type_id").union(found.notes.select("note_id", "note_type_id"))
            of_deck = self.manifest("card_manifest").select("note_id", "home_deck_id").union(found.cards.select("note_id", "home_deck_id"))
            members = of_type.select(F.lit("notetype").alias("facet"), F.col("note_type_id").alias("object_id"), "note_id").unionByName(of_deck.select(F.lit("deck").alias("facet"), F.col("home_deck_id").alias("object_id"), "note_id"))
            touched = diff.where("change in ('added', 'changed')").select("note_id").union(cards).union(changes.fan_out(facets, members))
            gone = diff.where("change = 'deleted'").select("note_id")
        else:
            indexed = index.note_ids()
            gone = indexed.join(here, "note_id", "left_anti")
            known = not self.get("force_hydration") and index.fingerprint() == found.fingerprint and gone.isEmpty() and here.join(indexed, "note_id", "left_anti").isEmpty()
            touched = manifests.mismatches(index.documents(), found.notes, found.cards, found.facets) if known else here
            if known and found.filtered_owners is not None:
                touched = touched.union(found.filtered_owners)
        return touched.distinct().join(here, "note_id", "left_semi"), gone.distinct()

    def audit(self, found: Inventory, index: IndexWriter) -> dict[str, int]:
        """Queue what changed and save the manifests, in one commit; counts of both kinds."""
        request = self.audit_request()
        live, gone = self.changed(found, index)
        sequence = self._next()
        queue = self._queued([(live, changes.NOTE_CONTENT), (gone, ALL_OF_DELETED)], sequence)
        tables = {"queue": queue, "note_manifest": manifests.checked_notes(found.notes), "card_manifest": manifests.checked_cards(found.cards), "facet_manifest": manifests.checked_facets(found.facets)}
        keys = {"sequence": sequence, "manifests_saved": True, "pending_fingerprint": found.fingerprint}
        if request is not None:
            keys |= self._audit_done(request["sequence"], ("force_hydration",)) or {}
        self.versions.publish(tables, False, keys)
        counts = {r.reasons: r["count"] for r in self.queue().where(F.col("sequence") == sequence).groupBy(F.col("reasons").bitwiseAND(changes.DELETED).alias("reasons")).count().collect()}
        self.promote_fingerprint(index)
        return {"changed": counts.get(0, 0), "deleted": counts.get(changes.DELETED, 0)}

    def promote_fingerprint(self, index: IndexWriter) -> bool:
        """The audited fingerprint becomes the index's once the queue is empty and no audit waits."""
        fingerprint = self.get("pending_fingerprint")
        if not fingerprint or self.has_pending() or self.audit_request() is not None:
            return False
        index.set_fingerprint(fingerprint)
        self.set("pending_fingerprint", None)
        return True

    # -- reconcile ---------------------------------------------------------------------

    def reconcile_some(self, source: Source, index: IndexWriter, limit: int = 250) -> dict[str, int]:
        """Bring the next queued notes into the index: plan, apply, delete, manifests, acknowledge."""
        claimed = self.pending(limit).select("note_id", "sequence", "reasons")
        claimed = self.spark.createDataFrame(claimed.collect(), claimed.schema)  # at most ``limit`` ids
        wanted = claimed.select("note_id")
        self.mark_attempted(claimed)
        changed, unchanged = index.upsert(source.notes(wanted), requested=wanted)
        found = source.inventory()
        live = manifests.for_notes(found.notes, wanted, "note_id")
        mine = manifests.for_notes(found.cards, wanted, "card_id")
        tables = {
            "note_manifest": manifests.upserted(manifests.without(self.manifest("note_manifest"), wanted, ["note_id"]), manifests.checked_notes(live), ["note_id"]),
            "card_manifest": manifests.replaced_for_owners(self.manifest("card_manifest"), wanted, mine),
            "queue": changes.acknowledge(self.queue(), claimed.select("note_id", "sequence", F.lit(None).cast("int").alias("reasons"))).select("note_id", "reasons", "sequence", "queued_at", "attempts"),
        }
        self.versions.publish(tables, False)
        self.promote_fingerprint(index)
        return {"changed": changed, "unchanged": unchanged, "left": self.pending_count()}

    def reconcile_all(self, source: Source, index: IndexWriter) -> dict[str, int] | None:
        """Compare the whole collection with the index; None if its fingerprint says that nothing changed."""
        found = source.inventory()
        if index.fingerprint() == found.fingerprint and not self.has_pending():
            return None
        changed, unchanged = index.upsert(source.notes())
        sequence = self._next()
        tables = {"note_manifest": manifests.checked_notes(found.notes), "card_manifest": manifests.checked_cards(found.cards), "facet_manifest": manifests.checked_facets(found.facets), "queue": self.queue().where("false")}
        self.versions.publish(tables, False, {"sequence": sequence, "manifests_saved": True, "pending_fingerprint": None})
        index.set_fingerprint(found.fingerprint)
        return {"changed": changed, "unchanged": unchanged}


def vector_batch(pending: DataFrame, size: int = 250) -> DataFrame:
    """The next vector work ``(note_id, action)`` of ``pending(note_id, action)``: deletions first, then by id."""
    order = F.when(F.col("action") == "delete", 0).otherwise(1)
    return pending.orderBy(order, "note_id").limit(size)


class Vocabulary:
    """The spelling vocabulary that searches use: the old one serves until a new one is ready."""

    def __init__(self, load):
        self._load, self.generation, self.frame = load, None, None

    def use(self, generation: int, refresh: bool = False) -> DataFrame:
        """The vocabulary at hand; a newer generation is taken up only when ``refresh`` is set."""
        if self.frame is None or refresh and generation != self.generation:
            fresh = self._load()
            fresh.count()  # built before it is swapped in
            self.frame, self.generation = fresh, generation
        return self.frame

    def is_stale(self, generation: int) -> bool:
        return generation != self.generation
