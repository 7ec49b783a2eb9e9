"""Exact vector search, vector maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO_NORM, UNIT_TOLERANCE = 1e-12, 1e-3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector; null for a null or zero one."""
    n = norm(v)
    # the length stands in an array, as inside a lambda it would be computed for every component
    return F.when(n > ZERO_NORM, F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, n: x / n))


def valid(v: Column, dimension: int) -> Column:
    """Right dimension, finite components, unit length."""
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & (F.abs(norm(v) - 1) <= UNIT_TOLERANCE), F.lit(False))


def topk(vectors: DataFrame, query: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """``(note_id, similarity)`` of the k best, ties by id. A zero query finds nothing.

    Planned as one scan with a bounded heap per task; ``allowed`` narrows the scan.
    """
    size = sum(x * x for x in query) ** 0.5
    if size <= ZERO_NORM or k <= 0:
        return vectors.select("note_id", F.lit(0.0).alias("similarity")).where("false")
    q = F.array(*(F.lit(float(x) / size) for x in query))
    rows = vectors if allowed is None else vectors.join(allowed.select("note_id").distinct(), "note_id", "left_semi")
    found = rows.select("note_id", norm(F.col("embedding")).alias("n"), dot(F.col("embedding"), q).alias("d")).where(F.col("n") > ZERO_NORM)
    return found.select("note_id", (F.col("d") / F.col("n")).alias("similarity")).orderBy(F.desc("similarity"), "note_id").limit(k)


#: Queries that one task multiplies at a time, and vectors that it takes together.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192


def unit(rows: list[list[float]], floor: float = ZERO_NORM) -> np.ndarray:
    """Rows of length one; a row shorter than ``floor`` is divided by it and so stays near zero."""
    v = np.asarray(rows, np.float64).reshape(len(rows), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), floor)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, column) of each row's k best scores, ties by id, without sorting all."""
    n = scores.shape[1]
    if n > k:
        bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, columns = np.nonzero(scores >= bound)
    else:
        rows, columns = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(scores)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], columns[keep]


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, note_id, similarity, rank)`` for a stated set of queries against all vectors.

    Queries are packed into blocks of ``QUERY_BLOCK`` rows of one array each; every batch of
    vectors meets every block as one matrix product and sends on its k best for each query.
    The blocks are broadcast while they are few and else each vector batch goes to all of
    them by a join; either way a task holds one block and one batch. Null and zero vectors
    are left out on both sides.
    """
    dims = queries.select(F.size("embedding")).where("embedding is not null").first()
    out = "query_id bigint, note_id bigint, similarity double"
    if dims is None or k <= 0:
        return vectors.sparkSession.createDataFrame([], out + ", rank int")

    def found(ids: np.ndarray, q: np.ndarray, notes: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        rows, columns = _best(notes, scores := q @ v.T, k)
        return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(notes[columns]), pa.array(scores[rows, columns])], ["query_id", "note_id", "similarity"])

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)

    def one_size(df: DataFrame, key: str) -> DataFrame:
        u = normalized(F.col("embedding"))
        return df.select(F.col(key).cast("bigint").alias(key), u.alias("u")).where(F.col("u").isNotNull() & (F.size("u") == dims[0]))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of (block, side, id, u), sorted: a block's queries, then its vectors."""
        asked, now = None, None
        for batch in batches:
            block, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                ids, u = batch.column(2).slice(a, b - a).to_numpy(), matrix(batch.column(3).slice(a, b - a))
                if side[a]:
                    if asked is not None and now == block[a]:
                        yield found(*asked, ids, u)
                elif now == block[a]:
                    asked = np.concatenate([asked[0], ids]), np.concatenate([asked[1], u])
                else:
                    asked, now = (ids, u), block[a]

    q = one_size(queries, "query_id")
    v = one_size(vectors, "note_id")
    n = q.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    if blocks == 1:
        # one block: it goes to every task in the closure, at most QUERY_BLOCK rows
        held = q.toArrow().combine_chunks()
        ids, mine = held.column("query_id").to_numpy(), matrix(held.column("u").combine_chunks())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, VECTOR_BLOCK):
                    part = batch.slice(at, VECTOR_BLOCK)
                    if len(ids):
                        yield found(ids, mine, part.column(0).to_numpy(), matrix(part.column(1)))

        every = v.mapInArrow(scan, out)
    else:
        tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = max(1, -(-tasks // blocks))
        numbered = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        left = numbered.select("block", F.lit(0).alias("side"), F.col("query_id").alias("id"), "u").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
        right = v.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"), F.lit(1).alias("side"), F.col("note_id").alias("id"), "u", F.pmod(F.xxhash64("note_id"), F.lit(slices)).alias("slice"))
        met = left.unionByName(right).withColumn("block", F.col("block") * slices + F.col("slice")).select("block", "side", "id", "u")
        every = met.repartition(max(tasks, blocks * slices), "block").sortWithinPartitions("block", "side").mapInArrow(product, out)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "note_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stale(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Notes ``(note_id, text_hash)`` whose vector is missing or of another text."""
    s = stored.select("note_id", F.col("content_hash").alias("_known"))
    return current.join(s, "note_id", "left").where(~F.col("text_hash").eqNullSafe(F.col("_known"))).select("note_id", "text_hash")


def orphans(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.select("note_id").join(current.select("note_id"), "note_id", "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, dimension: int) -> DataFrame:
    """Stored vectors with the incoming ones replaced; a bad vector is an error."""
    bad = incoming.where((F.size("embedding") != dimension) | (norm(F.col("embedding")) <= ZERO_NORM)).take(1)
    if bad:
        raise ValueError(f"vector {bad[0].note_id} has another dimension or no length")
    unit = incoming.withColumn("embedding", F.transform(normalized(F.col("embedding")), lambda x: x.cast("float")))
    return stored.join(incoming.select("note_id"), "note_id", "left_anti").unionByName(unit)


def source_text(plain: Column, title: Column) -> Column:
    return F.coalesce(F.when(F.trim(plain) != "", plain), title)


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 16, tokens: Callable[[str], list] | None = None, most_tokens: int = 512) -> DataFrame:
    """``(note_id, embedding)``, of length one, by any function of a list of texts; no model is included.

    ``tokens`` splits a text into pieces that join to it again; with it, a text is cut
    after ``most_tokens`` of them, as models with a window do.
    """

    def shortened(text: str) -> str:
        return text if tokens is None else "".join(tokens(text)[:most_tokens])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                found = unit(model([shortened(t) for t in part.column(1).to_pylist()])).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.tolist(), pa.list_(pa.float32()))], ["note_id", "embedding"])

    return texts.select("note_id", "text").mapInArrow(run, "note_id bigint, embedding array<float>")


def row_parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of each row's vectors in two tables, for comparing two models."""
    left, right = a.select("note_id", F.col("embedding").alias("x")), b.select("note_id", F.col("embedding").alias("y"))
    return left.join(right, "note_id").select("note_id", (dot(F.col("x"), F.col("y")) / (norm(F.col("x")) * norm(F.col("y")))).alias("cosine"))


def trend(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """``(keys, slope)``: least-squares slope of y over x; null without two different x."""
    return rows.groupBy(*keys).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"))
