"""Nearest neighbours on shifted Hilbert curves, completed by block bounds.

Vectors are projected (a random orthogonal map for each curve), shifted, and numbered
along a Hilbert curve. Each curve's keys are range-partitioned and sorted by Spark; a
vector's rank along its curve names its block of ``BLOCK`` vectors. A query meets its
own block and the two beside it on every curve, takes the exact distance to all vectors
there, and the curves' lists merge and rerank. That work is the same at every size.

What the windows find bounds how far a neighbour may be. Blocks of the first curve that
lie farther (by their centre and radius) hold none; a query goes on to the others, in
blocks of queries against blocks of vectors. With structure few blocks are left. Without
any (as on a sphere filled evenly) all are, the search is one whole scan, and only so does
it keep its recall. Either way the result is exact.

Equal vectors travel once, with their smallest ids, so a vector that a third of all
rows share costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, join_on_hidden_key, only, table

CURVES, DIMS, BITS = 4, 16, 3
BLOCK = 1000
#: Blocks of the first curve, and queries, that one task of the completion holds.
SUPER, GROUP = 32, 16_384
#: Rows whose projections set the curves' ranges.
FIT_ROWS = 5000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (n, dims), dims * bits <= 63.

    Skilling, "Programming the Hilbert curve" (2004), on all points at once.
    """
    x = cells.astype(np.uint64).T.copy()
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - np.uint64(1)
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint64(1 << level) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << np.uint64(1)) | ((axis >> np.uint64(level)) & np.uint64(1))
    return key


class _Curves:
    """The projections, ranges and shifts of all curves, fixed by a seed and a sample."""

    def __init__(self, sample: np.ndarray, curves: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        n = sample.shape[1]
        self.dims = min(DIMS, n)
        self.maps, self.low, self.high, self.shift = [], [], [], []
        for _ in range(curves):
            m = np.linalg.qr(rng.normal(size=(n, n)))[0][:, : self.dims]
            y = sample @ m
            self.maps.append(m)
            self.low.append(np.quantile(y, 0.001, axis=0))
            self.high.append(np.quantile(y, 0.999, axis=0))
            self.shift.append(rng.random(self.dims))

    def keys(self, v: np.ndarray, curve: int) -> np.ndarray:
        wide = np.maximum(self.high[curve] - self.low[curve], 1e-12)
        y = (v @ self.maps[curve] - self.low[curve]) / wide
        cells = np.clip((y * 0.5 + self.shift[curve] * 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert_keys(cells.astype(np.int64), BITS).view(np.int64)


def _valid(every: int):
    """(id, k1, k2, q, dim, vec) of the vectors that take part; vec holds doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2, q, dim, vec = [], [], [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype("<f8") + 0.0  # -0.0 becomes 0.0
                if not np.isfinite(x).all() or not x.any():
                    continue
                raw = x.tobytes()
                digest = xxhash.xxh128_intdigest(raw)
                ids.append(i)
                k1.append((digest >> 64) - (1 << 63))
                k2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                q.append(int(i % every == 0))
                dim.append(len(x))
                vec.append(raw)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, k1, k2, q, dim, vec), kinds, strict=True)], ["id", "k1", "k2", "q", "dim", "vec"])

    return run


def _stacked(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def _on_curves(curves: _Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _stacked(batch.column(batch.schema.names.index("vec")))
                for c in range(len(curves.maps)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(curves.keys(v, c)), *batch.columns], ["curve", "key", *batch.schema.names])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and queries before each row on its curve, in this partition."""
    part, before = TaskContext.get().partitionId(), np.zeros((2, 1), np.int64)
    for batch in batches:
        n = batch.num_rows
        curve, asks = batch.column("curve").to_numpy(), batch.column("q").to_numpy()
        place = np.zeros((2, n), np.int64)
        for c in np.unique(curve).tolist():
            if c >= before.shape[1]:
                before = np.pad(before, ((0, 0), (0, c + 1 - before.shape[1])))
            mine = curve == c
            place[0, mine] = before[0, c] + np.arange(mine.sum())
            place[1, mine] = before[1, c] + np.cumsum(asks[mine]) - asks[mine]
            before[:, c] += (mine.sum(), asks[mine].sum())
        rest = [batch.column(c) for c in ("curve", "k1", "k2", "q", "vec")]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(place[0]), pa.array(place[1]), *rest], ["part", "nth", "qth", "curve", "k1", "k2", "q", "vec"])


def _on_blocks(along: DataFrame, block: int) -> DataFrame:
    """``block`` of every row on its curve and ``grp`` of every query."""
    # one row for each partition of the range exchange and each curve
    parts = along.groupBy("curve", "part").agg(F.count("*").alias("n"), F.sum("q").alias("nq")).orderBy("curve", "part").collect()
    starts, total, last = [], [0, 0], None
    for r in parts:
        total = total if r.curve == last else [0, 0]
        last = r.curve
        starts.append((r.curve, r.part, *total))
        total = [total[0] + r.n, total[1] + r.nq]
    starts = along.sparkSession.createDataFrame(starts, "curve int, part int, first bigint, firstq bigint")
    placed = along.join(F.broadcast(starts), ["curve", "part"])
    block_of, grp = F.floor((F.col("first") + F.col("nth")) / block), F.floor((F.col("firstq") + F.col("qth")) / GROUP)
    return placed.select("curve", block_of.alias("block"), grp.alias("grp"), "k1", "k2", "q", "vec")


_HITS = "q1 bigint, q2 bigint, k1 bigint, k2 bigint, score double"


def _nearest(cv: np.ndarray, x: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest within ``bound``, and of all that tie with the last."""
    d = np.sqrt(((cv - x) ** 2).sum(axis=1))
    most = min(bound, np.partition(d, k - 1)[k - 1]) if len(d) > k else bound
    near = np.flatnonzero(d <= most)
    return near, d[near]


def _hits(found: list[tuple]) -> pa.Table:
    """One table of (query key, vector keys, distances) lists."""
    q1, q2, c1, c2, d = ([], [], [], [], [])
    for a, b, e, f, g in found:
        q1.append(np.full(len(g), a))
        q2.append(np.full(len(g), b))
        c1.append(e)
        c2.append(f)
        d.append(g)
    keys = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (q1, q2, c1, c2)]
    return pa.table([*(pa.array(c) for c in keys), pa.array(np.concatenate(d) if d else np.zeros(0))], ["q1", "q2", "k1", "k2", "score"])


def _searched(k: int):
    """All queries of a window against its block."""

    def run(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy() == 1
        k1, k2 = block.column("k1").to_numpy(), block.column("k2").to_numpy()
        if asks.all() or not asks.any():
            return _hits([])
        v = _stacked(block.column("vec").combine_chunks())
        c1, c2, cv = k1[~asks], k2[~asks], v[~asks]
        found = []
        for a, b, x in zip(k1[asks].tolist(), k2[asks].tolist(), v[asks], strict=True):
            near, d = _nearest(cv, x, k, np.inf)
            found.append((a, b, c1[near], c2[near], d))
        return _hits(found)

    return run


def _ball(rows: pa.Table) -> tuple[np.ndarray, float]:
    v = _stacked(rows.column("vec").combine_chunks())
    centre = v.mean(axis=0)
    return centre, float(np.sqrt(((v - centre) ** 2).sum(axis=1).max()))


def _summary(key: str, names: list[str]):
    """Centre, radius and greatest bound of the vectors of a group."""

    def run(rows: pa.Table) -> pa.Table:
        centre, radius = _ball(rows)
        bound = float(np.max(rows.column("bound").to_numpy())) if "bound" in rows.column_names else 0.0
        return pa.table([rows.column(key).slice(0, 1).combine_chunks(), pa.array([centre.astype("<f8").tobytes()]), pa.array([radius + bound])], names)

    return run


def _may_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group of queries and a run of blocks that are near enough to matter."""
    for batch in batches:
        if batch.num_rows:
            gap = np.sqrt(((_stacked(batch.column("qcentre")) - _stacked(batch.column("centre"))) ** 2).sum(axis=1))
            near = gap <= (batch.column("qreach").to_numpy() + batch.column("reach").to_numpy()) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("grp").filter(pa.array(near)), batch.column("super").filter(pa.array(near))], ["grp", "super"])


def _completed(k: int):
    """Queries of a group against a run of blocks, but for those their windows held."""

    def run(pair: pa.Table) -> pa.Table:
        asks = pair.column("asks").to_numpy() == 1
        if asks.all() or not asks.any():
            return _hits([])
        v = _stacked(pair.column("vec").combine_chunks())
        k1, k2, block, bound = (pair.column(c).to_numpy() for c in ("k1", "k2", "block", "bound"))
        q, q1, q2, qblock, bound = v[asks], k1[asks], k2[asks], block[asks], bound[asks]
        found = []
        for b in np.unique(block[~asks]).tolist():
            mine = ~asks & (block == b)
            cv, c1, c2 = v[mine], k1[mine], k2[mine]
            centre = cv.mean(axis=0)
            radius = np.sqrt(((cv - centre) ** 2).sum(axis=1).max())
            gap = np.sqrt(((q - centre) ** 2).sum(axis=1))
            rows = np.flatnonzero((np.abs(qblock - b) > 1) & (gap <= (radius + bound) * (1 + 1e-9)))
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                # the product only rules out; distances that count are taken from the vectors
                norms = (cv**2).sum(axis=1)[None, :] + (q[some] ** 2).sum(axis=1)[:, None]
                rough = norms - 2 * (q[some] @ cv.T)
                maybe = rough <= bound[some, None] ** 2 + 1e-9 * norms
                for i, row in zip(some.tolist(), maybe, strict=True):
                    if row.any():
                        at_row = np.flatnonzero(row)
                        near, d = _nearest(cv[at_row], q[i], k, float(bound[i]))
                        found.append((int(q1[i]), int(q2[i]), c1[at_row[near]], c2[at_row[near]], d))
        return _hits(found)

    return run


def _complete(first: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits within each query's ``bound`` outside the blocks that its window on the first curve held."""
    first = first.select(F.floor(F.col("block") / SUPER).alias("super"), "block", "k1", "k2", "vec")
    supers = first.select("super", "vec").groupBy("super").applyInArrow(_summary("super", ["super", "centre", "reach"]), "super bigint, centre binary, reach double")
    groups = queries.select("grp", "vec", "bound").groupBy("grp").applyInArrow(_summary("grp", ["grp", "qcentre", "qreach"]), "grp bigint, qcentre binary, qreach double")
    supers = checkpointed(supers)
    n = supers.count()
    pairs = groups.withColumn("super", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)).cast("bigint")))).join(supers, "super")
    pairs = checkpointed(pairs.mapInArrow(_may_meet, "grp bigint, super bigint"))
    asks = queries.join(pairs, "grp").select("grp", "super", "block", "k1", "k2", "vec", "bound", F.lit(1).alias("asks"))
    held = first.join(pairs, "super").select("grp", "super", "block", "k1", "k2", "vec", F.lit(0.0).alias("bound"), F.lit(0).alias("asks"))
    return held.unionByName(asks).groupBy("grp", "super").applyInArrow(_completed(k), _HITS)


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, curves: int = CURVES, block: int = BLOCK, windows_only: bool = False) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest vectors.

    Queries are the rows whose id is divisible by ``every``; every other row is a
    candidate. ``score`` is the Euclidean distance of the vectors in double
    precision; ties go to the smaller id. Rows with a null id, and vectors that are
    null, empty, zero, or hold null or non-finite components, take no part, nor do
    vectors of another than the most frequent dimension. Rows repeated with one id
    and vector count once. An empty table gives an empty result; other columns are not
    read, whatever their names. ``windows_only`` leaves out the completion: the result is
    then approximate, at a cost for each query that does not grow with the table.
    """
    spark = df.sparkSession
    rows = only(df, id=id_col, v=vector_col).select(F.col("id").cast("bigint").alias("id"), "v")
    rows = checkpointed(rows.mapInArrow(_valid(every), "id bigint, k1 bigint, k2 bigint, q int, dim int, vec binary"))
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return empty
    rows = rows.where(F.col("dim") == common.dim).select("id", "k1", "k2", "q", "vec")
    # the k + 1 smallest ids of each distinct vector; the limit is pushed below the shuffle
    by_id = Window.partitionBy("k1", "k2").orderBy("id")
    ids = rows.select("k1", "k2", "id").withColumn("_n", F.dense_rank().over(by_id)).where(F.col("_n") <= k + 1).select("k1", "k2", "id").distinct()
    distinct = checkpointed(rows.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.max("q").alias("q")))
    n = distinct.count()
    sample = distinct.orderBy("k1", "k2").limit(FIT_ROWS).select("vec").toPandas()["vec"]
    fitted = _Curves(np.stack([np.frombuffer(x, "<f8") for x in sample]), curves)
    placed = distinct.select("k1", "k2", "q", "vec").mapInArrow(_on_curves(fitted), "curve int, key bigint, k1 bigint, k2 bigint, q int, vec binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = placed.repartitionByRange(parts, "curve", "key", "k1", "k2").sortWithinPartitions("curve", "key", "k1", "k2")
    along = checkpointed(along.mapInArrow(_numbered, "part int, nth bigint, qth bigint, curve int, k1 bigint, k2 bigint, q int, vec binary"))
    located = _on_blocks(along, block)
    asks = located.where("q = 1")
    windows = asks.withColumn("block", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)))
    both = located.withColumn("asks", F.lit(0)).unionByName(windows.withColumn("asks", F.lit(1))).select("curve", "block", "k1", "k2", "vec", "asks")
    seen = checkpointed(both.groupBy("curve", "block").applyInArrow(_searched(k + 1), _HITS).distinct())
    if not windows_only:
        nth = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "k1", "k2"))
        bounds = seen.withColumn("_n", nth).where(F.col("_n") <= k + 1).groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2"))
        # fewer than k + 1 found: the windows bound nothing
        bounds = bounds.agg(F.when(F.count("*") > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
        queries = checkpointed(asks.where("curve = 0").join(bounds, ["k1", "k2"]).select("grp", "block", "k1", "k2", "vec", "bound"))
        seen = seen.union(_complete(located.where("curve = 0"), queries, k + 1)).distinct()
    hits = seen.join(ids, ["k1", "k2"]).select("q1", "q2", "id", "score")
    best = Window.partitionBy("q1", "q2").orderBy("score", "id")
    hits = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    lists = hits.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("found")).select(F.struct(F.col("q1").alias("k1"), F.col("q2").alias("k2")).alias("vkey"), "found")
    queries = rows.where("q = 1").select("id", F.struct("k1", "k2").alias("vkey")).distinct()
    answered = join_on_hidden_key(queries.withColumnRenamed("id", "query_id"), lists, "vkey", "inner")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = answered.select("query_id", F.posexplode(own).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
