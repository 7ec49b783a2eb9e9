"""Registered queries of what keeps an index true: manifests, journal, writer, vector store.

Stores are made in the session's shared folder, one for every call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import actions, changes, index, journal, manifests, related, vectors
from quern.operators.vector_store import VectorStore
from quern.operators.versions import Versions
from quern.operators.writer import IndexWriter
from quern.queries import ALIASES, Query, _first_vector, _notes, workspace
from quern.sources import notes as sources
from quern.sources.notes import table

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _root(spark, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _md5(text):
    """A digest without Python, so that SQL can follow it; ``manifests.digest`` is the default."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


# --- manifests ------------------------------------------------------------------------

_RAW = "raw as (select doc_id + 1 as note_id, n_chars as mod, doc_id % 7 as usn, length(lang) as mid, coalesce(text, '') as flds, ' ' || lang || ' ' || source || ' ' as tags from documents)"


def _raw(spark, d) -> DataFrame:
    """Documents as rows of the host's notes table."""
    return table(spark, d, "documents").select(
        (F.col("doc_id") + 1).alias("id"), F.col("n_chars").alias("mod"), (F.col("doc_id") % 7).alias("usn"), F.length("lang").alias("mid"), F.lit(0).alias("csum"),
        F.coalesce("text", F.lit("")).alias("flds"), F.concat(F.lit(" "), "lang", F.lit(" "), "source", F.lit(" ")).alias("tags"),
    )


_NOTE_SHOWN = "note_id, mod as modified_seconds, cast(usn as bigint) as usn, cast(mid as bigint) as note_type_id, cast(strlen(flds) as bigint) as fields_length, cast(strlen(tags) as bigint) as tags_length, md5(flds) as fields_digest, md5(tags) as tags_digest"


def _shown_notes(rows: DataFrame) -> DataFrame:
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fields_digest", "tags_digest")]
    return rows.select("note_id", "modified_seconds", "usn", "note_type_id", "fields_length", "tags_length", *hexed)


@query(f"with {_RAW} select {_NOTE_SHOWN} from raw")
def note_manifest(spark, d):
    return _shown_notes(manifests.note_manifest(_raw(spark, d), _md5))


@query(f"with {_RAW} select {_NOTE_SHOWN} from raw where note_id > 40 order by note_id limit 500")
def note_manifest_page(spark, d):
    return _shown_notes(manifests.page(manifests.note_manifest(_raw(spark, d), _md5), "note_id", 40, 500))


@query(f"with {_RAW} select {_NOTE_SHOWN} from raw where note_id - 1 in (select doc_id from labels)")
def note_manifest_for_ids(spark, d):
    wanted = table(spark, d, "labels").select((F.col("doc_id") + 1).alias("note_id"))
    return _shown_notes(manifests.for_notes(manifests.note_manifest(_raw(spark, d), _md5), wanted, "note_id"))


@query(f"with {_RAW} select note_id, 16 as fields_bytes, flds = '' as empty from raw")
def field_digests(spark, d):
    """The default digest has 128 bits, and an empty text its known value."""
    rows = manifests.note_manifest(_raw(spark, d))
    return rows.select("note_id", F.octet_length("fields_digest").alias("fields_bytes"), (F.lower(F.hex("fields_digest")) == "cae66941d9efbd404e4d88758ea67670").alias("empty"))


_CARDS = "cards as (select l_orderkey * 1000 + l_linenumber as id, min(l_orderkey) as nid, min(l_suppkey) as did, max(case when l_returnflag = 'R' then l_partkey else 0 end) as odid from lineitem group by 1), cm as (select id as card_id, nid as note_id, case when odid > 0 then odid when did > 0 then did else 0 end as home_deck_id from cards)"


def _cards(spark, d) -> DataFrame:
    """Order lines as rows of the host's cards table."""
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_orderkey").alias("nid"), F.min("l_suppkey").alias("did"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).otherwise(0)).alias("odid")
    )


@query(f"with {_CARDS} select * from cm where card_id > 5000 order by card_id limit 500")
def card_manifest_page(spark, d):
    return manifests.page(manifests.card_manifest(_cards(spark, d)), "card_id", 5000, 500)


@query(f"with {_CARDS} select * from cm where note_id > 0 and note_id in (select o_orderkey from orders where o_orderstatus = 'F')")
def card_manifest_for_notes(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("note_id"))
    return manifests.for_notes(manifests.card_manifest(_cards(spark, d)), wanted, "card_id")


@query(f"with {_CARDS} select distinct nid as note_id from cards where odid > 0")
def filtered_owners(spark, d):
    return manifests.owners_in_filtered_decks(_cards(spark, d))


@query(f"with {_CARDS} select distinct nid as note_id from cards where nid > 0 and did = 7")
def notes_of_cards(spark, d):
    return sources.notes_of_cards(_cards(spark, d).where("did = 7"))


_DECKS = "decks as (select n_nationkey + 1 as id, n_name as name from nation), models as (select r_regionkey + 1 as id, r_name as name, (select list(n_name order by n_name) from nation where n_regionkey = r_regionkey) as field_names from region)"


def _facets(spark, d) -> DataFrame:
    decks = table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.col("n_name").alias("name"))
    fields = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("field_names"))
    models = table(spark, d, "region").join(fields, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name"), "field_names")
    return manifests.facets(decks, models)


_FACETS = f"{_DECKS}, facets as (select 'deck' as facet, cast(id as bigint) as object_id, name as signature from decks union all select 'notetype', id, '[' || to_json(name) || ',' || to_json(field_names) || ']' from models)"


@query(f"with {_FACETS} select * from facets")
def facet_inventory(spark, d):
    return _facets(spark, d)


@query("select cast(s_suppkey as bigint) as id, s_name as name, s_nationkey >= 12 as filtered, s_suppkey = (select min(s_suppkey) from supplier where s_nationkey < 12) as current from supplier")
def deck_catalog(spark, d):
    decks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    found = sources.deck_catalog(decks.select("id", "name"), decks.where("s_nationkey < 12"))
    return found.withColumn("current", F.col("id") == F.lit(sources.current_deck(found, None, -5)))


@query(r"select doc_id + 1 as note_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as title_sha from documents")
def legacy_titles(spark, d):
    return sources.legacy_titles(_notes(spark, d)).select("note_id", F.sha2("title", 256).alias("title_sha"))


_SAVED = "saved as (select note_id, mod + case when mid = 2 and note_id % 5 = 0 then 1 else 0 end as mod from raw where note_id % 11 <> 3)"


def _saved(rows: DataFrame) -> DataFrame:
    edited = F.when(F.col("note_id") % 5 == 0, F.col("modified_seconds") + 1).otherwise(F.col("modified_seconds"))
    return rows.where("note_id % 11 <> 3").withColumn("modified_seconds", edited)


@query(f"with {_RAW}, {_SAVED} select note_id, mod as modified_seconds from raw where note_id % 11 = 3 or note_id % 4 = 0 union all select note_id, mod from saved where note_id % 4 <> 0 and note_id % 13 <> 0 order by 1")
def note_manifest_upsert(spark, d):
    """A stored manifest after an upsert of every fourth note and the missing ones, and a deletion of others."""
    j, rows = journal.Journal(Versions(spark, _root(spark, "journal"))), manifests.note_manifest(_raw(spark, d), _md5)
    j.replace_manifest("note_manifest", _saved(rows))
    j.delete_manifest("note_manifest", rows.where("note_id % 13 = 0 and note_id % 4 <> 0").select("note_id"))
    j.upsert_manifest("note_manifest", rows.where("note_id % 11 = 3 or note_id % 4 = 0"))
    return j.manifest("note_manifest").select("note_id", "modified_seconds")


@query(f"with {_CARDS}, c as (select * from cm where home_deck_id > 0 and note_id > 0) select card_id, note_id, home_deck_id from c where note_id % 3 <> 0 union all select card_id, note_id, home_deck_id + 1 from c where note_id % 3 = 0 and card_id % 2 = 0")
def card_manifest_owners(spark, d):
    """Cards of every third note replaced by half of them, in another deck."""
    j, rows = journal.Journal(Versions(spark, _root(spark, "journal"))), manifests.card_manifest(_cards(spark, d)).where("home_deck_id > 0 and note_id > 0")
    j.replace_manifest("card_manifest", rows)
    j.replace_cards_of(rows.where("note_id % 3 = 0").select("note_id"), rows.where("note_id % 3 = 0 and card_id % 2 = 0").withColumn("home_deck_id", F.col("home_deck_id") + 1))
    return j.manifest("card_manifest")


@query(f"with {_FACETS} select facet, object_id, case when object_id = 2 then signature || '*' else signature end as signature from facets where not (facet = 'deck' and object_id = 9)")
def facet_manifest_upsert(spark, d):
    j, rows = journal.Journal(Versions(spark, _root(spark, "journal"))), _facets(spark, d)
    j.replace_manifest("facet_manifest", rows.withColumn("facet", F.concat(F.lit(" "), F.upper("facet"))))
    j.delete_manifest("facet_manifest", rows.where("facet = 'deck' and object_id = 9").select("facet", "object_id"))
    j.upsert_manifest("facet_manifest", rows.where("object_id = 2").withColumn("signature", F.concat("signature", F.lit("*"))))
    return j.manifest("facet_manifest")


# --- audit and reconcile ----------------------------------------------------------------

_AUDIT = f"""with {_RAW}, cards as (select note_id + 100000 as card_id, note_id, usn + 1 as deck from raw), {_SAVED},
live as (
  select note_id from raw where note_id not in (select note_id from saved) union select note_id from raw join saved using (note_id) where raw.mod <> saved.mod
  union select note_id from cards where deck = 3 union select note_id from raw where mid = 5),
saved_more as (select note_id from saved union select -note_id + 1000000 from raw where note_id <= 20)"""


@query(f"{_AUDIT.replace('mid = 2 and note_id', 'note_id')} select note_id, 'changed' as change from live union all select note_id, 'deleted' from saved_more where note_id not in (select note_id from raw)")
def audit_classify(spark, d):
    """Notes to index again after edits, a renamed deck (3) and a changed note type, and notes that are gone."""
    j, rows = journal.Journal(Versions(spark, _root(spark, "journal"))), manifests.note_manifest(_raw(spark, d), _md5)
    cards = rows.select((F.col("note_id") + 100000).alias("card_id"), "note_id", (F.col("usn") + 1).alias("home_deck_id"))
    named = lambda changed: spark.createDataFrame([("deck", i, f"d{i}" + "x" * (changed and i == 3)) for i in range(1, 9)] + [("notetype", i, f"t{i}" + "x" * (changed and i == 5)) for i in range(1, 9)], manifests.FACET_MANIFEST)
    j.replace_manifest("note_manifest", _saved(rows).unionByName(rows.where("note_id <= 20").withColumn("note_id", 1000000 - F.col("note_id"))))
    j.replace_manifest("card_manifest", cards)
    j.replace_manifest("facet_manifest", named(False))
    j.set("manifests_saved", True)
    live, gone = j.changed(journal.Inventory(rows, cards, named(True), "f"), None)
    return live.withColumn("change", F.lit("changed")).unionByName(gone.withColumn("change", F.lit("deleted")))


def _nations(spark, d) -> DataFrame:
    """Nations as notes of two fields."""
    n = table(spark, d, "nation")
    fields = F.array(F.struct(F.lit("Front").alias("name"), F.col("n_name").alias("value")), F.struct(F.lit("Back").alias("name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("value")))
    return n.select((F.col("n_nationkey") + 1).cast("bigint").alias("note_id"), fields.alias("fields"), F.array(F.lit("#UWorld::1")).alias("tags"), F.array(F.lit("Deck")).alias("decks"), F.lit("Basic").alias("note_type"), F.array((F.col("n_nationkey") + 100).cast("bigint")).alias("card_ids"), F.lit(None).cast("string").alias("title"))


def _edited(notes: DataFrame) -> DataFrame:
    """Notes after edits: every third has another field, one is gone, one has another card only."""
    back = F.array(F.get("fields", F.lit(0)), F.struct(F.lit("Back").alias("name"), F.lit("edited text").alias("value")))
    notes = notes.where("note_id <> 5").withColumn("fields", F.when(F.col("note_id") % 3 == 0, back).otherwise(F.col("fields")))
    return notes.withColumn("card_ids", F.when(F.col("note_id") == 7, F.array(F.lit(999).cast("bigint"))).otherwise(F.col("card_ids")))


class _Nations:
    """A collection of nations for the journal."""

    def __init__(self, notes: DataFrame, fingerprint: str):
        self._notes, self.fingerprint = notes, fingerprint

    def notes(self, wanted: DataFrame | None = None) -> DataFrame:
        return self._notes if wanted is None else self._notes.join(wanted.select("note_id").distinct(), "note_id", "left_semi")

    def inventory(self) -> journal.Inventory:
        raw = F.array_join(F.transform("fields", lambda f: f["value"]), "\x1f")
        tags = F.concat(F.lit(" "), F.array_join("tags", " "), F.lit(" "))
        rows = self._notes.select(F.col("note_id").alias("id"), F.lit(1).alias("mod"), F.lit(0).alias("usn"), F.lit(1).alias("mid"), F.lit(0).alias("csum"), raw.alias("flds"), tags.alias("tags"))
        cards = self._notes.select(F.explode("card_ids").alias("card_id"), "note_id", F.lit(1).cast("bigint").alias("home_deck_id"))
        facets = self._notes.sparkSession.createDataFrame([("deck", 1, "Deck"), ("notetype", 1, '["Basic",["Front","Back"]]')], manifests.FACET_MANIFEST)
        return journal.Inventory(manifests.note_manifest(rows), cards, facets, self.fingerprint)


_FINAL = """final as (select n_nationkey + 1 as note_id, n_name as front, case when (n_nationkey + 1) % 3 = 0 then 'edited text' else 'region ' || n_regionkey end as back, case when n_nationkey = 6 then 999 else n_nationkey + 100 end as card from nation where n_nationkey <> 4)"""


@query(f"with {_FINAL} select cast(note_id as bigint) as note_id, front || chr(10) || back as plain_text, cast(card as bigint) as card_id, 'done' as state from final")
def reconcile_some(spark, d):
    """An audit queues what changed; the queue is worked off in batches until it is empty."""
    w = IndexWriter(spark, _root(spark, "index"))
    w.rebuild(_nations(spark, d), shards=2)
    j, old, new = journal.Journal(Versions(spark, _root(spark, "journal"))), _Nations(_nations(spark, d), "one"), _Nations(_edited(_nations(spark, d)), "two")
    w.set_fingerprint("one")
    j.audit(old.inventory(), w)  # an index that is proven to match: nothing to do
    j.request_audit("import")
    j.audit(new.inventory(), w)
    while j.has_pending():
        j.reconcile_some(new, w, limit=6)
    done = w.fingerprint() == "two" and j.audit_request() is None
    return w.documents().select("note_id", "plain_text", F.get("card_ids", F.lit(0)).alias("card_id"), F.lit("done" if done else "open").alias("state"))


@query(f"with {_FINAL} select cast(note_id as bigint) as note_id, front || chr(10) || back as plain_text, 'same' as again from final")
def reconcile_all(spark, d):
    """A whole comparison, and a second one that the fingerprint makes needless."""
    w = IndexWriter(spark, _root(spark, "index"))
    w.rebuild(_nations(spark, d), shards=2)
    j, new = journal.Journal(Versions(spark, _root(spark, "journal"))), _Nations(_edited(_nations(spark, d)), "two")
    j.reconcile_all(new, w)
    again = "same" if j.reconcile_all(new, w) is None else "different"
    return w.documents().select("note_id", "plain_text", F.lit(again).alias("again"))


@query(f"""with {_FINAL} select cast(note_id as bigint) as note_id from final where note_id % 4 = 0 or note_id = 7 union all select 5""")
def seed_mismatches(spark, d):
    """Stored notes that do not prove to be those of the collection: edited, of other cards, or missing."""
    now = _Nations(_nations(spark, d), "x").inventory()
    stored = _nations(spark, d).where("note_id <> 5")
    stored = stored.withColumn("tags", F.when(F.col("note_id") % 4 == 0, F.array(F.lit("other"))).otherwise(F.col("tags")))
    stored = stored.withColumn("card_ids", F.when(F.col("note_id") == 7, F.array(F.lit(1).cast("bigint"))).otherwise(F.col("card_ids")))
    return manifests.mismatches(stored, now.notes, now.cards, now.facets)


# --- writer -----------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(front || ' ' || back || ' #uworld::1 deck basic'), '[\p{L}\p{N}]+')"


def _upserted(spark, d) -> tuple[IndexWriter, list]:
    w = IndexWriter(spark, _root(spark, "index"))
    steps = [w.rebuild(_nations(spark, d).where("note_id <= 20"), shards=2)]
    steps.append(w.upsert(_edited(_nations(spark, d))))
    steps.append(w.delete(spark.createDataFrame([(2,), (3,), (99,)], "note_id bigint")))
    steps.append(w.delete(spark.createDataFrame([(99,)], "note_id bigint")))
    return w, steps


@query(f"with {_FINAL} select term, count(*) as frequency from (select unnest({_WORDS}) as term from final where note_id not in (2, 3)) group by 1")
def upsert_vocabulary(spark, d):
    """Word counts after a rebuild, an upsert of all notes and a deletion, by signed differences."""
    return _upserted(spark, d)[0].versions.read("vocabulary").select("term", "frequency")


@query(f"with {_FINAL} select cast(count(*) as bigint) as note_count, (select count(distinct term) from (select unnest({_WORDS}) as term from final where note_id not in (2, 3))) as vocabulary_size, 0::bigint as alias_count, 2 as schema_version, 3::bigint as generation from final where note_id not in (2, 3)")
def index_stats(spark, d):
    return _upserted(spark, d)[0].stats().drop("index_bytes")


@query("select * from (values ('upsert', 13, 12), ('delete', 2, 0), ('again', 0, 0)) as t(step, changed, unchanged)")
def upsert_counts(spark, d):
    """Notes that each step changed; of 25 notes 5 are new, 6 differ, 1 has another card only and 1 is gone."""
    _, (_, upsert, gone, again) = _upserted(spark, d)
    return spark.createDataFrame([("upsert", *upsert), ("delete", gone, 0), ("again", again, 0)], "step string, changed int, unchanged int")


@query(f"with {_FINAL} select cast(note_id as bigint) as note_id, '#uworld::1' as tag_key from final where note_id not in (2, 3)")
def tag_backfill(spark, d):
    """Source tags kept through changes, and made anew by another rule."""
    w, _ = _upserted(spark, d)
    w.backfill_tags(revision=2)
    return w.versions.read("source_tags").select("note_id", "tag_key")


@query(f"with {_FINAL} select cast(note_id as bigint) as note_id, sha256(cast(card as varchar)) as card_scope_hash from final where note_id not in (2, 3)")
def hash_backfill(spark, d):
    w, _ = _upserted(spark, d)
    w.versions.publish({"hashes": w.versions.read("hashes").withColumn("card_scope_hash", F.lit(""))}, False)
    w.backfill_hashes(revision=2)
    return w.versions.read("hashes").select("note_id", "card_scope_hash")


@query("select * from (values ('back', 1), ('Front', 2)) as t(display_name, position)")
def field_name_order(spark, d):
    """Names in order whatever their case."""
    w = IndexWriter(spark, _root(spark, "index"))
    lower = F.transform("fields", lambda f: F.struct(F.when(f["name"] == "Back", F.lit("back")).otherwise(f["name"]).alias("name"), f["value"].alias("value")))
    w.rebuild(_nations(spark, d).withColumn("fields", lower), shards=2)
    names = [r.display_name for r in w.field_names().collect()]  # a handful of names
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "display_name string, position int")


_ALIAS_ROWS = ", ".join(f"('{a}', '{c}', 'user')" for a, c in ALIASES)


@query(f"select distinct * from (values {_ALIAS_ROWS}, ('new', 'name', 'release')) as t(alias, canonical, source)")
def alias_sets(spark, d):
    """Aliases of two sources; the second is replaced, pairs of one name are left out."""
    w = IndexWriter(spark, _root(spark, "index"))
    pairs = lambda rows: spark.createDataFrame(rows, "alias string, canonical string")
    w.set_aliases(pairs([("old", "name"), ("x", "X")]), "release")
    w.set_aliases(pairs([(a.upper(), c) for a, c in ALIASES] + ALIASES[:1]))
    w.set_aliases(pairs([("new", "name")]), "release", replace_source=True)
    return w.aliases().select("alias", "canonical", "source")


# --- vectors ----------------------------------------------------------------------------


@query("select vec_id as note_id, case when label = 2 then 'second' else 'first' end as content_hash, null::bigint as source_generation from embeddings where label <> 4")
def vector_lifecycle(spark, d):
    """Known hashes after an upsert, a replacement and a deletion, each of which clears the marker."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding", "label")
    store = VectorStore(spark, _root(spark, "vectors"), len(_first_vector(spark, d)))
    store.upsert(v.withColumn("content_hash", F.lit("first")))
    store.mark(7)
    store.upsert(v.where("label = 2").withColumn("content_hash", F.lit("second")))
    store.delete(v.where("label = 4"))
    return store.known_hashes().withColumn("source_generation", F.lit(store.source_generation()).cast("bigint"))


@query("select vec_id as note_id, case when vec_id <= 0 then 'id' when label = 1 then 'dimension' when label = 2 then 'length' else 'not_finite' end as problem from embeddings where label in (1, 2, 3) or vec_id <= 0")
def vector_problems(spark, d):
    """What a check finds in stored rows that were damaged."""
    v = table(spark, d, "embeddings")
    e = F.col("embedding")
    bad = F.when(F.col("label") == 1, F.slice(e, 1, 3)).when(F.col("label") == 2, F.transform(e, lambda x: x * 2)).when(F.col("label") == 3, F.transform(e, lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x))).otherwise(e)
    store = VectorStore(spark, _root(spark, "vectors"), len(_first_vector(spark, d)))
    unit = v.select(F.col("vec_id").alias("note_id"), F.lit("h").alias("content_hash"), F.transform(bad, lambda x: x.cast("float")).alias("embedding"))
    store.versions.publish({"vectors": unit})
    return store.problems()


_SIMILAR = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


@query(f"select 0 as query_id, e.vec_id as note_id, cast(row_number() over (order by {_SIMILAR} desc, e.vec_id) as integer) as rank, round({_SIMILAR}, 5) as similarity, 'ready' as state from embeddings e, (select embedding from embeddings where vec_id = 0) q order by rank limit 20")
def semantic_search(spark, d):
    """Text to vector to nearest notes; the model of this query answers with a stored vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("note_id"), F.lit("h").alias("content_hash"), "embedding")
    first = _first_vector(spark, d)
    store = VectorStore(spark, _root(spark, "vectors"), len(first))
    store.upsert(v)
    hits, state = store.search(["any text", " "], lambda texts: [first for _ in texts], 20)
    return hits.select("query_id", "note_id", "rank", F.round("similarity", 5).alias("similarity"), F.lit(state).alias("state"))


_WORK = "work as (select user_id as note_id, case when arg_max(event_type, event_id) = 'error' then 'delete' else 'upsert' end as action from events group by 1)"


@query(f"with {_WORK} select note_id, action from work order by action, note_id limit 250")
def vector_delta_batch(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("sequence"), (F.col("event_type") == "error").alias("deleted"))
    return journal.vector_batch(changes.last_wins(events).select("note_id", "action"), 250)


@query("select label, round(regr_slope(list_sum(cast(embedding as double[])), vec_id), 8) as slope from embeddings group by 1")
def trend_slope(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.trend(table(spark, d, "embeddings").withColumn("total", total), "vec_id", "total", "label").withColumn("slope", F.round("slope", 8))


# --- related, selection, names ------------------------------------------------------------


@query("""with tags as (select doc_id + 1 as note_id, lang, lower(source) as tag_key from documents),
f as (select tag_key, count(*) as frequency from tags where tag_key in (select tag_key from tags where lang = 'es') group by 1),
r as (select note_id, count(*) as shared, min(frequency) as least, sum(frequency) as total from tags join f using (tag_key) where lang <> 'es' group by 1)
select note_id, row_number() over (order by shared desc, least, total, note_id) as position from r order by position limit 25""")
def related_best(spark, d):
    notes = _notes(spark, d).withColumn("tags", F.array(F.element_at("tags", 2)))
    found = related.related(related.source_tags(notes, providers=("src",)), notes.where("note_type = 'es'").select("note_id"))
    first = [r.note_id for r in related.best(found, 25).collect()]  # as many as are shown
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(first)], "note_id bigint, position bigint")


@query("select doc_id + 1 as note_id, lower(source) as keys from documents where lower(source) like 'src%' and source <> 'src'")
def related_key_sets(spark, d):
    sets = related.key_sets(related.source_tags(_notes(spark, d), providers=("src",)))
    return sets.select("note_id", F.array_join("keys", ",").alias("keys"))


@query("""with s as (select o_orderkey as note_id, row_number() over (order by o_orderkey) as position from orders where o_orderstatus = 'F')
select note_id from s where position between 10 and 40 union select note_id from s where note_id % 50 = 0 and position > 40""")
def selection_range(spark, d):
    from pyspark.sql import Window

    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("note_id"))
    shown = orders.withColumn("position", F.row_number().over(Window.orderBy("note_id")))
    checked = shown.where("note_id % 50 = 0").select("note_id")
    checked = actions.select_range(shown, checked, 9, 1, on=False)
    return actions.select_range(shown, checked, 40, 10)


@query("select cast(count(distinct l_orderkey) as integer) as n_notes, cast(count(distinct l_orderkey * 1000 + l_linenumber) as integer) as n_cards, min(l_orderkey * 1000 + l_linenumber) as first_card from lineitem where l_orderkey between 1 and 60")
def result_ids(spark, d):
    lines = table(spark, d, "lineitem").where("l_orderkey between 0 and 60")
    results = lines.groupBy(F.col("l_orderkey").alias("note_id")).agg(F.collect_list(F.when(F.col("l_orderkey") > 0, F.col("l_orderkey") * 1000 + F.col("l_linenumber")).otherwise(-1)).alias("card_ids"))
    return actions.result_ids(results).select(F.size("note_ids").alias("n_notes"), F.size("card_ids").alias("n_cards"), F.get("card_ids", F.lit(0)).alias("first_card"))


@query("select p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) as name, cast(len(string_split(replace(p_type, ' ', ';'), ';')) as integer) as parts from part")
def release_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.release_name(F.col("p_name")).alias("name"), F.size(T.release_parts(F.replace("p_type", F.lit(" "), F.lit(" ; ")))).alias("parts"))


@query("select doc_id + 1 as note_id, cast(1 as integer) as spans, cast(least(length(text), 40) as integer) as covered, 'a' as kind from documents where length(text) > 30")
def span_merge(spark, d):
    """Three spans that touch or overlap unite, within the text, and keep the kind of the first."""
    kind = "array<struct<start:int,end:int,kind:string>>"
    made = F.array(F.struct(F.lit(20), F.lit(40), F.lit("c")), F.struct(F.lit(-5), F.lit(10), F.lit("a")), F.struct(F.lit(10), F.lit(25), F.lit("b")), F.struct(F.lit(9_000_000), F.lit(9_000_009), F.lit("d"))).cast(kind)
    docs = table(spark, d, "documents").where("length(text) > 30")
    merged = docs.select((F.col("doc_id") + 1).alias("note_id"), T.merge_spans(T.clamp_spans(made, F.col("text"))).alias("m"))
    return merged.select("note_id", F.size("m").alias("spans"), F.aggregate("m", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("covered"), F.get("m", F.lit(0))["kind"].alias("kind"))
