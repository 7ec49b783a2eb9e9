"""The corpus pipeline: five stages, each written as Parquet and reread by the next.

toxicity -> exact dedup -> SimHash near-dedup -> mixing to target weights -> packing
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, packing, pfair, simhash, toxicity
from quern.llm.common import checkpointed, shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.7; the model is fitted on labelled rows of ``docs``.

    Every row is judged by its own text: null ids, repeated rows and null or empty texts
    (which score as clean) take part like any other.
    """
    model = toxicity.fit_on_tables(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.score(F.col("text")) < toxicity.REJECT)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest doc_id.

    A null id stays only where its group has no other; rows repeated with id and text keep one.
    """
    found = exact_dedup.exact_duplicates(docs).where("not kept")
    # what goes is named by id and text; a row repeated with its id keeps one copy
    gone = found.where("not (id <=> keep_id)").select(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    repeated = found.where("id <=> keep_id").select(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(exact_dedup.lower_ascii(F.coalesce("text", F.lit(""))), 256)
    marked = docs.withColumn("_text_sha", sha)
    same = F.expr("doc_id <=> _id and _text_sha = _sha")
    left = marked.join(gone, same, "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_text_sha"])
    return left.join(repeated, same, "left_anti").union(once).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that with the smallest doc_id, null last, then the least text hash.

    Rows are told apart by id and text, so a row that shares its id (or has none) goes only
    if its own text is a near copy. Empty and null texts are near copies of one another.
    """
    # a row is named by id and text, as ids may be null or repeated
    sha = F.unhex(F.sha2("text", 256))
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), sha.alias("sha")).alias("key"), "text")
    found = simhash.near_duplicates(named, "key").groupBy(F.col("id").alias("key")).agg(F.max("is_first").alias("first"), F.count("*").alias("n"))
    found = checkpointed(found.select(F.col("key.id").alias("_id"), F.col("key.sha").alias("_sha"), "first", "n"))
    same = F.expr("doc_id <=> _id and _text_sha <=> _sha")
    marked = docs.withColumn("_text_sha", sha)
    left = marked.join(found.where("not first").select("_id", "_sha"), same, "left_anti")
    repeated = found.where("first and n > 1").select("_id", "_sha")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_text_sha"])
    return left.join(repeated, same, "left_anti").union(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows in the order of the mix; packing computes their slots again, as files promise no order."""
    return pfair.mixed_documents(docs, weights=pfair.TARGET)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, numbered in the order of the mix."""
    placed = pfair.placed_documents(docs, weights=pfair.TARGET)
    return packing.pack(placed, slot_cols=("_slot", "_place")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: Stages 1, 3 and 5 (a trained model, components, packing) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every result is written to the shared folder and reread.

    A stage's folder goes when the next stage has been written, so that no more than two
    copies of the corpus stand; the last one stays for the reader.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    files, before = folder.getFileSystem(spark._jsc.hadoopConfiguration()), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{before}"), True)
        before = name
    return docs
