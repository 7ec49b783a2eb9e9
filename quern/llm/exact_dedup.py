"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut where its own content says so: after a sentence end or
line break once a chunk has ``MIN`` characters, and at ``MAX`` characters at the
latest. Equal texts therefore have equal chunk lists, and an edit only changes
the chunks around it.

Chunks, not documents, are shuffled once: ``distinct (hash, chunk)`` with map-side
combine proves which 64-bit hashes stand for one chunk alone. A hash with several
chunks is not trusted: wherever it occurs, the chunk's rank among the chunks with
that hash joins the recipe. After that, documents are compared by their ordered
lists of verified identifiers, about one hundredth of the text; the text itself
does not move again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import LOWER, UPPER, checkpointed, join_on_hidden_key, lower_ascii, only, table

MIN, MAX = 128, 1024
CUTS = rf"(?s).{{{MIN},{MAX}}}?(?<=[.!?\n])|.{{1,{MAX}}}"


def chunks(text: Column) -> Column:
    """The text's chunks in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(CUTS), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=chunk_hash) -> DataFrame:
    """One row per input row: ``(id, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when identical after lower-casing A-Z only; null is the empty
    text. The row with the largest id of each group stays. Rows repeated with the
    same id and text are counted one by one and exactly one of them stays. A null
    id never wins against another id; a group of null ids keeps one row and has a
    null ``keep_id``. Empty tables give an empty result. Texts are compared whole, however
    long; other columns are not read, whatever their names. ``hashed`` maps a chunk
    to a long; any function gives right results.
    """
    docs = only(df, id=id_col, text=text_col).select("id", lower_ascii(F.coalesce("text", F.lit(""))).alias("text"))
    cut = docs.select("id", "text", chunks(F.col("text")).alias("parts"))
    single = cut.select(F.explode("parts").alias("chunk")).select(hashed(F.col("chunk")).alias("h"), "chunk").distinct()
    clash = checkpointed(single.groupBy("h").count().where("count > 1").select("h"))

    recipes = cut.select("id", F.sha2("text", 256).alias("sha"), F.transform("parts", hashed).alias("recipe"))
    if clash.isEmpty():
        recipes = recipes.withColumn("told", F.lit(None).cast("array<struct<at:int,nth:int>>"))
    else:
        at = cut.select("id", F.sha2("text", 256).alias("sha"), F.posexplode("parts").alias("at", "chunk")).withColumn("h", hashed(F.col("chunk"))).join(clash, "h", "left_semi")
        ranked = at.select("h", "chunk").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        told = at.join(ranked, ["h", "chunk"]).select("id", "sha", F.struct("at", "nth").alias("one")).distinct()
        told = told.groupBy("id", "sha").agg(F.array_sort(F.collect_list("one")).alias("told")).withColumnRenamed("id", "told_id").withColumnRenamed("sha", "told_sha")
        recipes = recipes.join(told, F.expr("id <=> told_id and sha = told_sha"), "left").select("id", "sha", "recipe", "told")

    recipe = F.struct("recipe", F.coalesce("told", F.array().cast("array<struct<at:int,nth:int>>")).alias("told")).alias("recipe")
    rows = recipes.select("id", "sha", recipe).groupBy("recipe", "id", "sha").agg(F.count("*").alias("n"))
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    out = join_on_hidden_key(rows, groups, "recipe", "inner")
    copies = out.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select("id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents)
select doc_id, max(doc_id) over w as keep_id, cast(count(*) over w as bigint) as group_size,
       doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""
