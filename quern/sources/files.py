"""Alias resources and delimited files."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normalize, release_name, release_parts

ALIAS_SCHEMA = "aliases array<struct<alias:string,alias_norm:string,canonical:string,canonical_norm:string>>"


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``(alias, canonical)`` of a JSON or JSON.GZ resource.

    The ``_norm`` spellings are preferred; records without a name or that map to
    themselves are left out. A file without an ``aliases`` array is an error.
    """
    raw = spark.read.schema(ALIAS_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if raw.where("aliases is null").take(1):
        raise ValueError(f"{path} has no aliases")
    rows = raw.select(F.inline("aliases"))
    pick = lambda a, b: normalize(F.coalesce(F.when(F.trim(a) != "", F.col(a)), F.col(b)))
    rows = rows.select(pick("alias_norm", "alias").alias("alias"), pick("canonical_norm", "canonical").alias("canonical"))
    return rows.where("alias <> '' and canonical <> '' and alias <> canonical").distinct()


def merge_aliases(*maps: DataFrame) -> DataFrame:
    """Union of alias maps, normalised, without self pairs."""
    out = maps[0].select("alias", "canonical")
    for m in maps[1:]:
        out = out.unionByName(m.select("alias", "canonical"))
    out = out.select(normalize(F.col("alias")).alias("alias"), normalize(F.col("canonical")).alias("canonical"))
    return out.where("alias <> '' and canonical <> '' and alias <> canonical").distinct()


def read_piped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", header=True)


def read_zipped(spark: SparkSession, archive: str, prefix: str) -> DataFrame:
    """Rows of the one text file of a zip archive whose name begins with ``prefix``.

    The archive is read where Spark reads files; one task unpacks it (a member of a zip
    cannot be split) and the rows are dealt out after it. A byte order mark is dropped.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    found = [n for n in z.namelist() if n.rsplit("/", 1)[-1].startswith(prefix) and n.lower().endswith(".txt")]
                    if len(found) != 1:
                        raise ValueError(f"one {prefix} file was expected, not {found}")
                    with z.open(found[0]) as member:
                        lines = io.TextIOWrapper(member, encoding="utf-8-sig", newline="")
                        while some := list(itertools.islice(lines, 10_000)):
                            yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in some], pa.string())], ["value"])

    lines = spark.read.format("binaryFile").load(archive).select("content").mapInArrow(names, "value string")
    header = lines.first()
    if header is None:
        raise ValueError(f"{prefix}: the file is empty")
    columns = header.value.split("|")
    parts = F.split("value", r"\|", -1)
    rows = lines.where(F.col("value") != header.value).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(*(F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)))


_ROUTE = r"\s*\([^)]*\)\s*$"


def release_products(main: DataFrame, ingredients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``products(alias, surface, item, ingredient)`` and ``spellings(ingredient, surface)`` of a drug release.

    Suppressed and retired rows are left out. A row's names are its brand, its display name
    without the route, and its synonyms; a name needs two characters and a letter.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")  # noqa: E731, any white space
    known = ingredients.select(strip(F.col("RXCUI")).alias("item"), release_name(F.col("INGREDIENT")).alias("ingredient"), strip(F.col("INGREDIENT")).alias("surface")).where("item <> '' and ingredient <> ''")
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    rows = main.where(blank("SUPPRESS_FOR") & blank("IS_RETIRED"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    names = F.concat(F.array(strip(text("BRAND_NAME")), strip(F.regexp_replace(text("DISPLAY_NAME"), _ROUTE, ""))), release_parts(text("DISPLAY_NAME_SYNONYM")))
    each = rows.select(strip(F.col("RXCUI")).alias("item"), F.explode(names).alias("surface")).withColumn("alias", release_name(F.col("surface")))
    each = each.where((F.char_length("alias") >= 2) & F.col("alias").rlike(r"\p{L}"))
    return each.join(known.select("item", "ingredient").distinct(), "item").select("alias", "surface", "item", "ingredient"), known.select("ingredient", "surface")


def read_tabbed(spark: SparkSession, path: str, columns: str = "front string, back string, tags string") -> DataFrame:
    """Tab-separated rows; lines that begin with # are directives."""
    return spark.read.schema(columns).csv(path, sep="\t", comment="#")
