"""BM25 retrieval over the index tables, for many queries in one plan.

A phrase is a list of index tokens; phrases of one token are read from the counts, longer
ones are found by position. ``clauses(query_id, group_id, phrase_id)`` says which phrases
may satisfy each group of a query. What is asked is small beside the index: it is counted
and broadcast, so a term of most notes is scored where its rows lie and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.joins import join_on_hidden_key, join_small
from quern.operators.index import shard, weight

K1, B = 1.2, 0.75
#: idf of a phrase in half of the notes or more (fixed value).
LEAST_IDF = 1e-6


def _sharded(asked: DataFrame, table: DataFrame, shards: int | None) -> tuple[DataFrame, list[str]]:
    """Join columns of a table by term; published ones are split by shard, which prunes their folders."""
    if shards and "shard" in table.columns:
        return asked.withColumn("shard", shard(F.col("term"), shards)), ["shard", "term"]
    return asked, ["term"]


def with_frequency(asked: DataFrame, terms: DataFrame, shards: int | None = None) -> DataFrame:
    """``asked`` (with ``term``) and the number of notes ``df`` of each term that occurs."""
    asked, on = _sharded(asked, terms, shards)
    return join_small(terms, asked, on).drop("shard")


def word_hits(counts: DataFrame, asked: DataFrame, shards: int | None = None) -> DataFrame:
    """``(asked columns, note_id, wf, len)`` of one-token phrases."""
    asked, on = _sharded(asked, counts, shards)
    return join_small(counts.drop("n"), asked, on).drop("shard", "term")


def phrase_hits(postings: DataFrame, phrases: DataFrame, terms: DataFrame, shards: int | None = None) -> DataFrame:
    """``(phrase_id, note_id, wf, len)`` of phrases ``(phrase_id, tokens)``; none spans columns.

    A phrase begins where its rarest token says it may, so only that token's postings are
    read in full; at these places the other tokens are looked up, each by note, column and
    position, and the phrase occurs where all are found. A phrase with a token that no note
    holds has no hits.
    """
    each = phrases.select("phrase_id", F.size("tokens").alias("size"), F.posexplode("tokens").alias("at", "term"))
    known = with_frequency(each, terms, shards)
    rarest = known.groupBy("phrase_id").agg(F.min(F.struct("df", "at", "term")).alias("r"), F.count("*").alias("found"), F.first("size").alias("size")).where("found = size")
    anchors, on = _sharded(rarest.select("phrase_id", F.col("r.at").alias("at"), F.col("r.term").alias("term")), postings, shards)
    begins = join_small(postings, anchors, on).select("phrase_id", "note_id", "len", "col", (F.col("pos") - F.col("at")).alias("begin")).where("begin >= 0")
    wanted, on = _sharded(join_small(begins, each, "phrase_id").withColumn("pos", F.col("begin") + F.col("at")), postings, shards)
    places = join_small(postings.drop("len"), wanted, [*on, "note_id", "col", "pos"])
    whole = places.groupBy("phrase_id", "note_id", "col", "begin", "size").agg(F.count("*").alias("found"), F.first("len").alias("len")).where("found = size")
    return whole.groupBy("phrase_id", "note_id").agg(F.sum(weight()).alias("wf"), F.first("len").alias("len"))


def idf(n_docs: int, n: Column) -> Column:
    found = F.log((F.lit(float(n_docs)) - n + 0.5) / (n + 0.5))
    return F.when(found > 0, found).otherwise(F.lit(LEAST_IDF))


def _parts(hits: DataFrame, corpus: tuple[int, float]) -> DataFrame:
    n_docs, mean = corpus
    part = idf(n_docs, F.col("df")) * F.col("wf") * (K1 + 1) / (F.col("wf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    return hits.select("query_id", "group_id", "note_id", part.alias("part"))


def word_parts(counts: DataFrame, terms: DataFrame, asked: DataFrame, corpus: tuple[int, float], shards: int | None = None) -> DataFrame:
    """``(query_id, group_id, note_id, part)``: BM25 of every hit of words ``asked(query_id, group_id, term)``.

    ``corpus`` is the number of notes and their mean length.
    """
    return _parts(word_hits(counts, with_frequency(asked, terms, shards), shards), corpus)


def phrase_parts(postings: DataFrame, phrases: DataFrame, clauses: DataFrame, terms: DataFrame, corpus: tuple[int, float], shards: int | None = None) -> DataFrame:
    """The same for phrases ``(phrase_id, tokens)`` of ``clauses(query_id, group_id, phrase_id)``."""
    hits = phrase_hits(postings, phrases, terms, shards)
    counts = hits.groupBy("phrase_id").agg(F.count("*").alias("df"))
    return _parts(join_small(join_on_hidden_key(hits, counts, "phrase_id"), clauses, "phrase_id"), corpus)


def matched(*parts: DataFrame) -> DataFrame:
    """``(query_id, note_id, score, groups)``: sums (less is better) and groups satisfied. One exchange, by note."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("query_id", "note_id").agg((-F.sum("part")).alias("score"), F.countDistinct("group_id").alias("groups"))


def ranked(matches: DataFrame, limit: int, order: list[Column] | None = None) -> DataFrame:
    """Best ``limit`` per query with their 1-based rank; ties by note id."""
    w = Window.partitionBy("query_id").orderBy(*(order or [F.col("score")]), "note_id")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def corpus_size(doc_stats: DataFrame) -> tuple[int, float]:
    r = doc_stats.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    return r.n, r.mean or 1.0


def strict(matches: DataFrame, clauses: DataFrame) -> DataFrame:
    """Matches that satisfy every group of their query."""
    wanted = clauses.groupBy("query_id").agg(F.countDistinct("group_id").alias("wanted"))
    return join_small(matches, wanted, "query_id").where("groups = wanted").drop("wanted")
