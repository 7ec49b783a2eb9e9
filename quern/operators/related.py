"""Related notes by complete source tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.joins import join_on_hidden_key, join_small

# The default providers of source tags and how they are written.
PROVIDERS = {"uworld": "UWorld", "amboss": "AMBOSS"}


def _parts(tag: Column) -> Column:
    return F.filter(F.transform(F.split(tag, "::"), lambda p: F.trim(p)), lambda p: p != "")


def _bare(part: Column) -> Column:
    return F.regexp_replace(F.trim(part), "^[#^]+", "")


def provider_of(tag: Column, providers=tuple(PROVIDERS)) -> Column:
    """The provider that a tag names, null for none.

    A part names a provider at a word boundary. A last part that is nothing but the
    provider is a broad root and does not count. The first such part decides.
    """
    parts = _parts(tag)
    n = F.size(parts)

    def named(part: Column, at: Column) -> Column:
        low = F.lower(_bare(part))
        hits = [F.when(low.rlike(rf"(?:^|[^a-z0-9]){p}(?:$|[^a-z])") & ~((low == p) & (at == n - 1)), F.lit(p)) for p in providers]
        return F.coalesce(*hits)

    return F.get(F.filter(F.transform(parts, named), lambda p: p.isNotNull()), F.lit(0))


def source_tags(notes: DataFrame, providers=tuple(PROVIDERS)) -> DataFrame:
    """``(note_id, tag_key, display, provider, leaf)``; one row per distinct key of a note."""
    rows = notes.select("note_id", F.posexplode(F.transform("tags", lambda t: F.trim(t))).alias("at", "display")).where("display <> ''")
    rows = rows.withColumn("tag_key", F.lower("display")).withColumn("provider", provider_of(F.col("display"), providers)).where("provider is not null")
    leaf = _bare(F.element_at(_parts(F.col("display")), -1))
    rows = rows.withColumn("leaf", F.when(leaf != "", leaf).otherwise(F.initcap("provider")))
    first = rows.groupBy("note_id", "tag_key").agg(F.min_by(F.struct("display", "provider", "leaf"), "at").alias("t"))
    return first.select("note_id", "tag_key", "t.*")


def reason(provider: Column, leaf: Column) -> Column:
    name = F.coalesce(*(F.when(provider == p, F.lit(shown)) for p, shown in PROVIDERS.items()), F.initcap(provider))
    return F.concat_ws(" · ", F.lit("Related"), name, F.when(F.lower(F.trim(leaf)) != provider, F.trim(leaf)))


def related(tags: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(note_id, shared, least, total, score)`` for notes that share a tag with a seed.

    ``tags(note_id, tag_key)`` holds each pair once, ``seeds(note_id)``. A tag's frequency
    counts all of its notes, seeds too; seeds themselves are left out of the result. Seeds
    and their tags are broadcast while they are few. The frequencies come from an aggregate
    by tag, whose key is hidden from the join, so a tag of a third of all notes is split.
    """
    seeds = seeds.select("note_id").distinct()
    wanted = join_small(tags, seeds, "note_id", "left_semi").select("tag_key").distinct()
    shared = join_small(tags, wanted, "tag_key", "left_semi").select("note_id", "tag_key")
    counts = shared.groupBy("tag_key").agg(F.count("*").alias("frequency"))
    out = join_on_hidden_key(join_small(shared, seeds, "note_id", "left_anti"), counts, "tag_key")
    return out.groupBy("note_id").agg(F.count("*").alias("shared"), F.min("frequency").alias("least"), F.sum("frequency").alias("total"), (F.count("*") + F.sum(1 / F.col("frequency"))).alias("score"))


def key_sets(tags: DataFrame) -> DataFrame:
    """``(note_id, keys)``: each note's distinct tag keys, sorted."""
    return tags.groupBy("note_id").agg(F.array_sort(F.collect_set("tag_key")).alias("keys"))


def replaced(stored: DataFrame, notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored source tags with those of some notes replaced: all rows of ``notes(note_id)`` go, ``fresh`` come."""
    return stored.join(notes.select("note_id").distinct(), "note_id", "left_anti").unionByName(fresh.select(stored.columns))


ORDER = ("shared desc", "least", "total", "note_id")


def best(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("shared"), "least", "total", "note_id").limit(max(0, limit))
