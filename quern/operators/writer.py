"""Writing an index: rebuild, upsert, delete, tags, hashes, aliases, statistics.

An index is the tables of ``index.publish``; a change writes those it touches and commits
them as one version. Rows of notes that change are replaced (an anti-join and a union),
counts take signed differences. What refers to cards only does not count as content, so
it leaves the generation as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normalize
from quern.operators import index
from quern.operators.related import replaced, source_tags
from quern.operators.versions import Conflict, Versions
from quern.sources.files import read_aliases

SCHEMA = 2
HASH_REVISION, TAG_REVISION = 1, 1
# Endings of the host's collection files.
COLLECTIONS = (".anki2", ".anki21", ".anki21b")
ALIASES = "alias string, canonical string, weight double, source string"
HASHES = "note_id bigint, content_hash string, card_scope_hash string"


class UnsafePath(ValueError):
    """A root that may hold something else."""


def guarded(spark: SparkSession, root: str) -> str:
    """A root for an index: not a collection file, and empty, new or an index already."""
    name = root.rstrip("/").rsplit("/", 1)[-1].lower()
    if name.endswith(COLLECTIONS) or not name:
        raise UnsafePath("an index must be apart from the collection")
    fs, p = Versions(spark, root)._path(root)
    if fs.exists(p):
        if not fs.getFileStatus(p).isDirectory():
            raise UnsafePath("the root of an index is a folder")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        if names and "_log" not in names and any(not n.startswith(("_", ".")) for n in names):
            raise UnsafePath("the folder holds something other than an index")
    return root


def hashes(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", index.content_hash().alias("content_hash"), index.card_scope_hash(F.col("card_ids")).alias("card_scope_hash"))


class IndexWriter:
    def __init__(self, spark: SparkSession, root: str, single_field: bool = False):
        self.spark, self.versions, self.single = spark, Versions(spark, guarded(spark, root)), single_field

    # -- reading -----------------------------------------------------------------------

    def _prepare(self, notes: DataFrame) -> DataFrame:
        raw = notes.drop("plain_fields", "plain_text", "columns", "normalized_text", "vocabulary_text")  # stored notes have these
        return index.prepare_single_field(raw) if self.single else index.prepare(raw)

    def documents(self, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """Stored notes in id order, of some ids or all."""
        rows = self.versions.read("prepared")
        rows = rows if ids is None else rows.join(ids.select("note_id").distinct(), "note_id", "left_semi")
        rows = rows.orderBy("note_id")
        return rows if limit is None else rows.limit(limit)

    def note_ids(self) -> DataFrame:
        return self.versions.read("hashes").select("note_id") if self.versions.has("hashes") else self.spark.createDataFrame([], "note_id bigint")

    def field_names(self) -> DataFrame:
        """Field names without regard to the case of A to Z, then as they are."""
        return self.versions.read("field_names").orderBy(F.translate("display_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "display_name")

    def fingerprint(self) -> str | None:
        return self.versions.key("fingerprint")

    def set_fingerprint(self, value: str) -> None:
        self.versions.publish({}, False, {"fingerprint": value})

    def stats(self) -> DataFrame:
        """One row: notes, words, aliases, bytes on disk, schema, generation."""
        entry = self.versions.entry()
        size = 0
        for folder in entry["tables"].values():
            fs, p = self.versions._path(f"{self.versions.root}/{folder}")
            size += fs.getContentSummary(p).getLength()
        count = lambda name: self.versions.read(name).count() if name in entry["tables"] else 0
        row = (entry["keys"].get("n_notes", 0), count("vocabulary"), count("aliases"), size, entry["keys"].get("schema", 0), entry["generation"])
        return self.spark.createDataFrame([row], "note_count bigint, vocabulary_size bigint, alias_count bigint, index_bytes bigint, schema_version int, generation bigint")

    # -- writing -----------------------------------------------------------------------

    def rebuild(self, notes: DataFrame, shards: int = index.SHARDS) -> int:
        """All tables anew from notes; aliases stay. The old version serves until the commit."""
        index.publish(self.versions, notes, single_field=self.single, shards=shards, extra={"hashes": hashes(notes)}, keys={"schema": SCHEMA, "hash_revision": HASH_REVISION, "tag_revision": TAG_REVISION})
        return self.versions.generation()

    def plan(self, notes: DataFrame, requested: DataFrame | None = None) -> DataFrame:
        """``index.plan_upsert`` against the stored hashes, with those that were seen."""
        stored = self.versions.read_or_empty("hashes", HASHES)
        found = index.plan_upsert(hashes(notes), stored, requested)
        return found.join(stored.select("note_id", F.col("content_hash").alias("seen_hash")), "note_id", "left")

    def apply(self, notes: DataFrame, plan: DataFrame) -> tuple[int, int]:
        """Carry out a plan: (notes written or removed, notes unchanged).

        A note whose stored hash is no longer what the plan saw is a conflict and nothing
        is written. If only card scopes change, the generation stays.
        """
        folder = f"{self.versions.root}/_plan/{uuid.uuid4().hex}"
        plan.write.parquet(folder)  # used by every table below
        plan = self.spark.read.parquet(folder)
        stored = self.versions.read_or_empty("hashes", HASHES)
        moved = plan.join(stored.select("note_id", F.col("content_hash").alias("_now")), "note_id", "left").where(~F.col("seen_hash").eqNullSafe(F.col("_now")))
        if not moved.isEmpty():
            raise Conflict("the index changed after it was planned for")
        counts = {r.action: r["count"] for r in plan.groupBy("action").count().collect()}
        unchanged = counts.pop("unchanged", 0)
        if counts:
            if not self.versions.has("prepared"):
                self.rebuild(notes)
            else:
                self._write(notes, plan, content=bool(set(counts) - {"rescope"}))
        fs, p = self.versions._path(folder)
        fs.delete(p, True)
        return sum(counts.values()), unchanged

    def _write(self, notes: DataFrame, plan: DataFrame, content: bool) -> None:
        read, shards = self.versions.read, self.versions.key("shards")
        touched = plan.where("action <> 'unchanged'").select("note_id")
        coming = notes.join(plan.where("action in ('insert', 'update', 'rescope')").select("note_id"), "note_id", "left_semi")
        fresh = self._prepare(coming)
        tables = {
            "prepared": read("prepared").join(touched, "note_id", "left_anti").unionByName(fresh),
            "hashes": read("hashes").join(touched, "note_id", "left_anti").unionByName(hashes(coming)),
        }
        keys: dict = {}
        if content:
            old = read("prepared").join(touched, "note_id", "left_semi")
            by_shard = lambda df: df.withColumn("shard", index.shard(F.col("term"), shards))
            for name, rows in (("postings", index.postings(fresh)), ("counts", index.term_counts(fresh))):
                tables[name] = read(name).join(touched, "note_id", "left_anti").unionByName(by_shard(rows))
            added = index.term_counts(fresh).groupBy("term").agg(F.count("*").alias("df"))
            gone = index.term_counts(old).groupBy("term").agg(F.count("*").alias("df"))
            tables["terms"] = by_shard(index.merge_counts(read("terms"), added, gone, count="df"))
            tables["vocabulary"] = by_shard(index.merge_counts(read("vocabulary"), index.vocabulary(fresh), index.vocabulary(old)))
            names = index.merge_counts(read("field_names"), index.field_name_counts(coming), index.field_name_counts(old), "normalized_name", "note_count")
            shown = read("field_names").select("normalized_name", "display_name").unionByName(index.field_name_counts(coming).select("normalized_name", "display_name"))
            tables["field_names"] = names.join(shown.groupBy("normalized_name").agg(F.min("display_name").alias("display_name")), "normalized_name").select("normalized_name", "display_name", "note_count")
            tables["stats"] = read("stats").join(touched, "note_id", "left_anti").unionByName(index.doc_stats(fresh))
            tables["source_tags"] = replaced(read("source_tags"), touched, source_tags(coming))
            total = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            (plus, more), (minus, less) = total(index.doc_stats(fresh)), total(index.doc_stats(old))
            n = self.versions.key("n_notes") + plus - minus
            keys = {"n_notes": n, "mean_length": (self.versions.key("mean_length") * self.versions.key("n_notes") + more - less) / n if n else 1.0}
        self.versions.publish(tables, content, keys, partition_by=index.SHARDED)

    def upsert(self, notes: DataFrame, requested: DataFrame | None = None) -> tuple[int, int]:
        """Plan and apply: (changed, unchanged). Stored notes that were asked for (or all) and do not come are removed."""
        return self.apply(notes, self.plan(notes, requested))

    def delete(self, ids: DataFrame) -> int:
        """Remove notes; ids that are not there change nothing, not even the generation."""
        none = self.versions.read("prepared").where("false")
        plan = self.plan(none, ids)
        return self.apply(none, plan)[0]

    # -- derived tables that may be of an older rule -----------------------------------

    def replace_tags(self, notes: DataFrame) -> None:
        """Source tags of some notes anew."""
        self.versions.publish({"source_tags": replaced(self.versions.read("source_tags"), notes, source_tags(notes))}, False)

    def backfill_tags(self, revision: int = TAG_REVISION) -> bool:
        """All source tags anew if they were made by another rule or are missing; content is the same."""
        if self.versions.key("tag_revision") == revision and self.versions.has("source_tags"):
            return False
        self.versions.publish({"source_tags": source_tags(self.versions.read("prepared"))}, False, {"tag_revision": revision})
        return True

    def backfill_hashes(self, revision: int = HASH_REVISION) -> bool:
        """All hashes anew from the stored notes, if they were made by another rule or are missing."""
        if self.versions.key("hash_revision") == revision and self.versions.has("hashes"):
            return False
        self.versions.publish({"hashes": hashes(self.versions.read("prepared"))}, False, {"hash_revision": revision})
        return True

    # -- aliases -----------------------------------------------------------------------

    def aliases(self) -> DataFrame:
        return self.versions.read_or_empty("aliases", ALIASES)

    def set_aliases(self, pairs: DataFrame, source: str = "user", replace_source: bool = False, keys: dict | None = None) -> int:
        """Store ``(alias, canonical)`` pairs of a source; the number of them that count.

        Names are normalised; a pair without a name or of one name with itself is left out.
        """
        named = pairs.select(normalize(F.col("alias")).alias("alias"), normalize(F.col("canonical")).alias("canonical"))
        rows = named.where("alias <> '' and canonical <> '' and alias <> canonical").distinct().select("alias", "canonical", F.lit(1.0).alias("weight"), F.lit(source).alias("source"))
        n, stored = rows.count(), self.aliases()
        kept = stored.where(F.col("source") != source) if replace_source else stored.join(rows, ["alias", "canonical", "source"], "left_anti")
        if n or replace_source:
            self.versions.publish({"aliases": kept.unionByName(rows)}, True, keys)
        return n

    def load_aliases(self, path: str, source: str = "release") -> int:
        """Aliases of a JSON or JSON.GZ file; 0 if the same file was loaded before."""
        raw = self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha")).first().sha
        if self.versions.key(f"aliases:{source}") == raw:
            return 0
        return self.set_aliases(read_aliases(self.spark, path), source, True, {f"aliases:{source}": raw})

    def archive_other_schema(self) -> str | None:
        """Move an index of another schema aside and begin anew with its aliases; where it went."""
        if not self.versions.current() or self.versions.key("schema") == SCHEMA:
            return None
        old, kept = self.versions.root, self.versions.has("aliases")
        aside = f"{old}.archived-{uuid.uuid4().hex[:8]}"
        fs, source = self.versions._path(old)
        _, target = self.versions._path(aside)
        fs.rename(source, target)
        aliases = Versions(self.spark, aside).read("aliases") if kept else None
        self.versions.publish({"aliases": aliases} if kept else {}, True, {"schema": SCHEMA})
        return aside
