"""The life of stored vectors: upsert, delete, known hashes, markers, checks, search.

Vectors lie in one versioned table. A marker names the lexical generation that they were
made from; it is cleared in the commit that begins a change and set again by ``mark``, so
an interrupted refresh is seen as incomplete. Embedding is any function of a list of
texts; no model is included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import text_hash
from quern.operators import vectors
from quern.operators.versions import Versions
from quern.operators.writer import guarded

SCHEMA = "note_id bigint, content_hash string, embedding array<float>"
HITS = "query_id int, note_id bigint, rank int, similarity double"
READY, EMPTY, INCOMPLETE, UNAVAILABLE = "ready", "empty", "incomplete", "unavailable"

Embedder = Callable[[list[str]], list[list[float]]]


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, dimension: int):
        self.spark, self.versions, self.dimension = spark, Versions(spark, guarded(spark, root)), dimension

    # -- state -------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        return self.versions.read_or_empty("vectors", SCHEMA)

    def count(self) -> int:
        return self.rows().count()

    def source_generation(self) -> int | None:
        """The lexical generation of the vectors; None while a change is incomplete."""
        return self.versions.key("source_generation")

    def mark(self, generation: int) -> None:
        self.versions.publish({}, False, {"source_generation": generation})

    def clear_mark(self) -> None:
        self.versions.publish({}, False, {"source_generation": None})

    def status(self, generation: int | None = None) -> dict:
        """Number of vectors, and whether they are those of a lexical generation."""
        n, mark = self.count(), self.source_generation()
        state = EMPTY if not n else INCOMPLETE if mark is None or generation is not None and mark != generation else READY
        return {"count": n, "source_generation": mark, "state": state}

    def known_hashes(self, ids: DataFrame | None = None) -> DataFrame:
        """``(note_id, content_hash)`` of all vectors, or of the notes asked for (none for none)."""
        rows = self.rows().select("note_id", "content_hash")
        return rows if ids is None else rows.join(ids.select("note_id").distinct(), "note_id", "left_semi")

    def problems(self) -> DataFrame:
        """``(note_id, problem)``: ids that repeat, wrong dimensions, components that are not finite, wrong lengths."""
        v = F.col("embedding")
        finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        found = F.when(F.col("note_id").isNull() | (F.col("note_id") <= 0), "id").when(v.isNull() | (F.size(v) != self.dimension), "dimension").when(~finite, "not_finite").when(F.abs(vectors.norm(v) - 1) > vectors.UNIT_TOLERANCE, "length")
        rows = self.rows()
        repeated = rows.groupBy("note_id").count().where("count > 1").select("note_id", F.lit("repeated").alias("problem"))
        return rows.select("note_id", found.alias("problem")).where("problem is not null").unionByName(repeated)

    # -- changes -----------------------------------------------------------------------

    def upsert(self, incoming: DataFrame) -> None:
        """Replace or add ``(note_id, content_hash, embedding)``; the marker is cleared by the same commit.

        A vector of another dimension or without length is an error and nothing is written.
        """
        self.versions.publish({"vectors": vectors.upsert(self.rows(), incoming.select("note_id", "content_hash", "embedding"), self.dimension)}, True, {"source_generation": None})

    def delete(self, ids: DataFrame) -> int:
        """Remove vectors; the number of those that were there. Nothing to remove is no change."""
        gone = self.known_hashes(ids).count()
        if gone:
            self.versions.publish({"vectors": self.rows().join(ids.select("note_id").distinct(), "note_id", "left_anti")}, True, {"source_generation": None})
        return gone

    def remove(self, ids: DataFrame) -> tuple[int, str]:
        """``delete`` for callers that go on: (removed, state), the state telling of a failure."""
        try:
            return self.delete(ids), READY
        except Exception:  # the store may be out of reach; the caller tries again later
            return 0, UNAVAILABLE

    def index_documents(self, notes: DataFrame, embedder: Embedder, batch: int = 16, generation: int | None = None) -> int:
        """Embed notes ``(note_id, plain_text, title)`` whose text is new or has changed; their number.

        With ``generation`` vectors of notes that are gone are removed and the marker is set.
        """
        texts = notes.select("note_id", vectors.source_text(F.col("plain_text"), F.col("title")).alias("text")).where("trim(text) <> ''")
        texts = texts.withColumn("text_hash", text_hash(F.col("text")))
        wanted = vectors.stale(texts.select("note_id", "text_hash"), self.rows())
        todo = texts.join(wanted.select("note_id"), "note_id", "left_semi")
        n = todo.count()
        if n:
            made = vectors.embed(todo, embedder, batch).join(todo.select("note_id", F.col("text_hash").alias("content_hash")), "note_id")
            self.upsert(made)
        if generation is not None:
            self.delete(vectors.orphans(self.rows(), notes))
            self.mark(generation)
        return n

    def apply_batch(self, work: DataFrame, notes: DataFrame, embedder: Embedder) -> dict[str, int]:
        """One batch of ``journal.vector_batch``: deletions first, then the notes that are to be embedded."""
        gone = self.delete(work.where("action = 'delete'"))
        made = self.index_documents(notes.join(work.where("action <> 'delete'").select("note_id"), "note_id", "left_semi"), embedder)
        return {"deleted": gone, "embedded": made}

    # -- search ------------------------------------------------------------------------

    def search(self, texts: list[str], embedder: Embedder, limit: int = 50, allowed: DataFrame | None = None) -> tuple[DataFrame, str]:
        """``(query_id, note_id, rank, similarity)`` of the nearest notes of each text, and the state.

        A blank text or an empty store finds nothing. If the embedder fails, nothing is
        found and the state says so.
        """
        none = self.spark.createDataFrame([], HITS)
        asked = [(q, t) for q, t in enumerate(texts) if (t or "").strip()]
        rows = self.rows()
        if rows.isEmpty():
            return none, EMPTY
        if not asked:
            return none, READY
        try:
            found = [(q, [float(x) for x in v]) for (q, _), v in zip(asked, vectors.unit(embedder([t for _, t in asked])), strict=True)]
        except Exception:  # a model is outside code; search goes on without it
            return none, UNAVAILABLE
        if allowed is not None:
            rows = rows.join(allowed.select("note_id").distinct(), "note_id", "left_semi")
        queries = self.spark.createDataFrame(found, "query_id bigint, embedding array<double>")
        hits = vectors.topk_batch(rows, queries, limit)
        return hits.select(F.col("query_id").cast("int").alias("query_id"), "note_id", F.col("rank").cast("int").alias("rank"), "similarity"), READY
