"""The lexical index as tables: prepared notes, postings, statistics, upserts.

Texts are normalised once, when notes are prepared; everything else is read from the
prepared columns. ``publish`` writes all tables of an index from one scan of the notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import index_tokens, normalize, plain_text, tokenize, truncate
from quern.operators.related import source_tags
from quern.operators.versions import Versions

#: Full-text columns and their BM25 weights (fixed values).
WEIGHTS = {"title": 8.0, "body": 3.0, "tags": 4.0, "decks": 2.5, "note_type": 2.5}


def prepare(notes: DataFrame) -> DataFrame:
    """Plain fields, title, plain text, and the normalised texts that are searched."""
    # one note rarely has many fields: flatten, clean once per field, gather again
    flat = notes.select("note_id", F.posexplode_outer("fields").alias("at", "field"))
    flat = flat.select("note_id", "at", F.col("field.name").alias("name"), plain_text(F.coalesce("field.value", F.lit(""))).alias("value"))
    gathered = flat.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "value"))).alias("f"))
    gathered = gathered.select("note_id", F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))).alias("plain_fields"))
    return _searchable(notes.join(gathered, "note_id"))


def prepare_single_field(notes: DataFrame) -> DataFrame:
    """``prepare`` for notes of exactly one field: no shuffle."""
    first = F.element_at("fields", 1)
    value = plain_text(F.coalesce(first["value"], F.lit("")))
    return _searchable(notes.withColumn("_value", value).withColumn("plain_fields", F.array(F.struct(first["name"].alias("name"), F.col("_value").alias("value")))).drop("_value"))


def _searchable(notes: DataFrame) -> DataFrame:
    values = F.filter(F.transform("plain_fields", lambda f: f["value"]), lambda v: v != "")
    out = notes.withColumn("_values", values).withColumn("plain_text", F.array_join("_values", "\n"))
    given = plain_text(F.coalesce("title", F.lit("")))
    fallback = F.when(F.size("_values") > 0, truncate(F.try_element_at("_values", F.lit(1)), 180)).otherwise(F.concat(F.lit("Note "), F.col("note_id").cast("string")))
    out = out.withColumn("title", F.coalesce(F.when(given != "", given), fallback))
    texts = {"title": F.col("title"), "body": F.col("plain_text"), "tags": F.array_join("tags", " "), "decks": F.array_join("decks", " "), "note_type": F.coalesce("note_type", F.lit(""))}
    out = out.withColumn("columns", F.struct(*(normalize(t).alias(c) for c, t in texts.items())))
    # parts join at blanks, where normal forms do not interact
    joined = lambda names: F.concat_ws(" ", *(F.when(F.col(f"columns.{c}") != "", F.col(f"columns.{c}")) for c in names))
    return out.select(
        "note_id", "card_ids", "title", "fields", "plain_fields", "tags", "decks", "note_type", "plain_text", "columns",
        joined(texts).alias("normalized_text"), joined([c for c in texts if c != "title"]).alias("vocabulary_text"),
    )


def column_texts(prepared: DataFrame) -> DataFrame:
    """The normalised full-text columns of each note."""
    return prepared.select("note_id", "columns.*")


def _length() -> Column:
    return sum((F.size(index_tokens(F.col(c))) for c in WEIGHTS), F.lit(0)).cast("bigint")


def postings(prepared: DataFrame) -> DataFrame:
    """``(term, note_id, len, col, pos)``, one row per token occurrence; ``len`` is the note's."""
    texts = column_texts(prepared)
    each = F.array(*(F.struct(F.lit(c).alias("col"), index_tokens(F.col(c)).alias("tokens")) for c in WEIGHTS))
    return texts.select("note_id", _length().alias("len"), F.inline(each)).select("note_id", "len", "col", F.posexplode("tokens").alias("pos", "term"))


def weight() -> Column:
    return F.coalesce(*(F.when(F.col("col") == c, F.lit(w)) for c, w in WEIGHTS.items()))


def term_counts(prepared: DataFrame) -> DataFrame:
    """``(term, note_id, wf, n, len)``: weighted and plain frequency; combined before the shuffle."""
    return postings(prepared).groupBy("term", "note_id").agg(F.sum(weight()).alias("wf"), F.count("*").alias("n"), F.first("len").alias("len"))


def doc_stats(prepared: DataFrame) -> DataFrame:
    """``(note_id, len)``: tokens over all columns. No shuffle."""
    return column_texts(prepared).select("note_id", _length().alias("len"))


def vocabulary(prepared: DataFrame) -> DataFrame:
    """``(term, frequency)`` of application words, title excluded."""
    return prepared.select(F.explode(tokenize(F.col("vocabulary_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))


def field_name_counts(notes: DataFrame) -> DataFrame:
    """``(normalized_name, display_name, note_count)``: notes with each field name."""
    names = notes.select("note_id", F.explode(F.transform("fields", lambda f: f["name"])).alias("display_name"))
    names = names.withColumn("normalized_name", normalize(F.col("display_name"))).where("normalized_name <> ''")
    return names.groupBy("normalized_name").agg(F.min("display_name").alias("display_name"), F.countDistinct("note_id").alias("note_count"))


def content_hash() -> Column:
    """sha256 of a canonical JSON of what is searched; cards and times do not count."""
    return F.sha2(F.to_json(F.struct("decks", "fields", "note_id", "note_type", "tags")), 256)


def card_scope_hash(card_ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.transform(card_ids, lambda c: c.cast("string"))), 256)


def plan_upsert(incoming: DataFrame, stored: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """``(note_id, action)``: insert, update, rescope (cards only), unchanged, or missing.

    Both sides have ``note_id, content_hash, card_scope_hash``. With ``requested`` only
    these ids are looked at; a stored id that is asked for and does not come is missing.
    """
    if requested is not None:
        incoming = incoming.join(requested.select("note_id").distinct(), "note_id", "left_semi")
        stored = stored.join(requested.select("note_id").distinct(), "note_id", "left_semi")
    a = incoming.select("note_id", F.col("content_hash").alias("c1"), F.col("card_scope_hash").alias("s1"), F.lit(True).alias("here"))
    b = stored.select("note_id", F.col("content_hash").alias("c0"), F.col("card_scope_hash").alias("s0"), F.lit(True).alias("there"))
    action = (
        F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "insert")
        .when(~F.col("c1").eqNullSafe(F.col("c0")), "update").when(~F.col("s1").eqNullSafe(F.col("s0")), "rescope").otherwise("unchanged")
    )
    return a.join(b, "note_id", "full").select("note_id", action.alias("action"))


def merge(stored: DataFrame, incoming: DataFrame, plan: DataFrame) -> DataFrame:
    """The stored table after a plan: rows to write replace, missing rows go."""
    gone = plan.where("action <> 'unchanged'").select("note_id")
    written = incoming.join(plan.where("action in ('insert', 'update', 'rescope')").select("note_id"), "note_id", "left_semi")
    return stored.join(gone, "note_id", "left_anti").unionByName(written)


def merge_counts(stored: DataFrame, added: DataFrame, removed: DataFrame, key: str = "term", count: str = "frequency") -> DataFrame:
    """Counts after adding and removing; keys at or under zero go."""
    signed = stored.select(key, count).unionByName(added.select(key, count)).unionByName(removed.select(key, (-F.col(count)).alias(count)))
    return signed.groupBy(key).agg(F.sum(count).alias(count)).where(F.col(count) > 0)


#: Folders that a published index is split into by term, so that a search reads few of them.
SHARDS = 16
SHARDED = {"postings": "shard", "counts": "shard", "terms": "shard", "vocabulary": "shard"}


def shard(term: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def publish(versions: Versions, notes: DataFrame, aliases: DataFrame | None = None, single_field: bool = False, shards: int = SHARDS, extra: dict[str, DataFrame] | None = None, keys: dict | None = None) -> int:
    """Build all tables of an index and commit them as one version.

    ``prepared`` is written first and everything else is derived from it, so the notes
    are scanned and normalised once. Tables by term are in folders by a hash of the term.
    ``extra`` tables and ``keys`` are committed with them; other tables of the root stay.
    """
    stage = Versions(versions.spark, f"{versions.root}/_stage")
    stage.publish({"prepared": prepare_single_field(notes) if single_field else prepare(notes)})
    prepared = stage.read("prepared")

    def by_term(df: DataFrame) -> DataFrame:
        # a term of most notes is spread over eight tasks of its folder
        spread = [F.pmod("note_id", F.lit(8))] if "note_id" in df.columns else []
        return df.withColumn("shard", shard(F.col("term"), shards)).repartition("shard", *spread).sortWithinPartitions("shard", "term")

    stage.publish({"counts": by_term(term_counts(prepared))}, partition_by=SHARDED)
    stats, counts = doc_stats(prepared), stage.read("counts")
    corpus = stats.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    words = vocabulary(prepared)
    tables = {
        "prepared": prepared, "stats": stats, "counts": counts, "postings": by_term(postings(prepared)),
        "terms": counts.groupBy("shard", "term").agg(F.count("*").alias("df")).repartition("shard"),
        "vocabulary": by_term(words), "field_names": field_name_counts(prepared), "source_tags": source_tags(prepared), **(extra or {}),
    }
    if aliases is not None:
        tables["aliases"] = aliases
    version = versions.publish(tables, keys={"n_notes": corpus.n, "mean_length": corpus.mean or 1.0, "shards": shards, **(keys or {})}, partition_by=SHARDED)
    # the staged tables have been written again under their final names
    stage.publish({}, drop=("prepared", "counts"))
    stage.prune()
    return version
