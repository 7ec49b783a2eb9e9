"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within distance 4 have a midpoint within 2 of both, so
emitting every variant within half the radius and shuffling on the variants
finds every pair. Over all 64 bits that is 2,081 variants a fingerprint. We keep
the idea but first drop one of three blocks of bits: of at most four differing
bits, some block holds at least two, so the other two blocks differ in at most
two bits and half *that* radius is one. Three blocks, each dropped in turn, cost
131 variants instead of 2,081. A collision is then a candidate, verified on all
64 bits.

A bucket with more than ``BUCKET`` fingerprints is not compared pairwise: its
members go through the full ball of radius two, where everything in one bucket
is within distance four of everything else, so a star of links is exact and the
number of links stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER_TABLE, checkpointed, join_on_hidden_key, only
from quern.llm.components import connected_components

BITS, SEED, RADIUS = 64, 42, 4
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Largest bucket that is compared pairwise; larger ones use the full ball.
BUCKET = 256
_CHUNK = 1 << 16


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned SimHash of one UTF-8 text (see ``fingerprints``)."""
    words = (text or b"").translate(LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[width - 1 :].tolist()
    first = [0, *(ends[: len(words) - width] + 1).tolist()]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash of each row's word shingles.

    A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+`` and a shingle is
    ``width`` words joined by one space, repeats counted. A text with fewer words
    is one shingle; a null, empty or blank text has fingerprint zero. A bit is 1
    if it is set in more than half of the shingle hashes (XXH64, seed 42).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = only(df, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def _masks(kept: list[int], radius: int) -> list[int]:
    out = [0] + [1 << b for b in kept]
    if radius > 1:
        out += [(1 << b) | (1 << c) for i, b in enumerate(kept) for c in kept[:i]]
    return out


def _variants(fps: DataFrame, balls: list[tuple[int, int, list[int]]]) -> DataFrame:
    """``(block, variant, fp)``: for each (block, kept bits, masks), every flipped copy."""
    masks = [_as_long(m) for _, _, of_block in balls for m in of_block]
    block, keep, until = F.lit(balls[-1][0]), F.lit(_as_long(balls[-1][1])), len(masks)
    for d, kept, of_block in reversed(balls):
        block = F.when(F.col("at") < until, d).otherwise(block)
        keep = F.when(F.col("at") < until, F.lit(_as_long(kept))).otherwise(keep)
        until -= len(of_block)
    dealt = fps.select("fp", F.posexplode(F.lit(masks).cast("array<bigint>")).alias("at", "mask"))
    return dealt.select(block.alias("block"), F.col("fp").bitwiseAND(keep).bitwiseXOR(F.col("mask")).alias("variant"), "fp")


def _spanning(members: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members within RADIUS of one another."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= RADIUS
    open_, links = np.ones(len(members), bool), []
    for root in range(len(members)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            for other in np.flatnonzero(near[at] & open_):
                open_[other] = False
                links.append((at, int(other)))
                queue.append(int(other))
    return [(members[a], members[b]) for a, b in links]


def _sorted_groups(batches: Iterator[pa.RecordBatch], on_small, on_large):
    """Walk sorted ``(block, variant, fp)`` batches; yield what the callbacks give.

    ``on_small(groups)`` gets the complete buckets of up to BUCKET members as a
    list of arrays. ``on_large(members, first)`` gets larger ones piece by piece,
    so that no bucket is ever held whole.
    """
    key, held, over, first = None, [], False, None

    def close(small):
        nonlocal held
        if held and not over:
            group = np.concatenate(held)
            if len(group) > 1:
                small.append(group)
        held = []

    for batch in batches:
        if not batch.num_rows:
            continue
        block, variant = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fp = batch.column(2).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (variant[1:] != variant[:-1])) + 1
        starts = np.concatenate([[0], cuts])
        stops = np.concatenate([cuts, [len(fp)]])
        small, large = [], []
        # buckets of one row inside the batch need no look at all
        keep = stops - starts > 1
        keep[0] = keep[-1] = True
        for a, b in zip(starts[keep].tolist(), stops[keep].tolist(), strict=True):
            now = (block[a], variant[a])
            if now != key:
                close(small)
                key, over, first = now, False, fp[a]
            if over:
                large.append((fp[a:b], first))
            else:
                held.append(fp[a:b])
                if sum(map(len, held)) > BUCKET:
                    large.append((np.concatenate(held), first))
                    held, over = [], True
        yield from on_small(small)
        for members, center in large:
            yield from on_large(members, center)
    small = []
    close(small)
    yield from on_small(small)


def _links_frame(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "u", "v"])


def _candidate_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: verified links; kind 1: members of an over-full bucket (u = v)."""

    def on_small(groups):
        u, v = [], []
        by_size: dict[int, list[np.ndarray]] = {}
        for g in groups:
            by_size.setdefault(len(g) if len(g) <= 4 else 0, []).append(g)
        for n, found in by_size.items():
            if n:
                grid = np.stack(found)
                for i in range(n):
                    for j in range(i):
                        near = np.bitwise_count(grid[:, i] ^ grid[:, j]) <= RADIUS
                        u.append(grid[near, i])
                        v.append(grid[near, j])
            else:
                pairs = [p for g in found for p in _spanning(g)]
                if pairs:
                    both = np.array(pairs, np.uint64)
                    u.append(both[:, 0])
                    v.append(both[:, 1])
        if u:
            pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
            yield _links_frame(0, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    yield from _sorted_groups(batches, on_small, lambda members, _: [_links_frame(1, members, members)])


def _ball_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of the full ball: a star around each bucket's first fingerprint."""

    def on_small(groups):
        if groups:
            u = np.concatenate([g[1:] for g in groups])
            v = np.concatenate([np.full(len(g) - 1, g[0], np.uint64) for g in groups])
            pairs = np.unique(np.stack([u, v], axis=1), axis=0)
            yield _links_frame(0, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))

    yield from _sorted_groups(batches, on_small, lambda members, first: [_links_frame(0, members, np.full(len(members), first, np.uint64))])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """``(u, v)`` links that connect every two distinct fingerprints within distance 4.

    ``fps(fp)`` holds distinct fingerprints. Within one bucket only a spanning
    forest of the links is kept, so the components are exact while the number of
    links stays linear in the number of fingerprints.
    """
    every = (1 << BITS) - 1
    balls = []
    for d, (low, high) in enumerate(BLOCKS):
        dropped = ((1 << high) - 1) ^ ((1 << low) - 1)
        kept = [b for b in range(BITS) if not low <= b < high]
        balls.append((d, every ^ dropped, _masks(kept, 1)))
    out = "kind int, u bigint, v bigint"
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(ball_list, rows, run):
        v = _variants(rows, ball_list).select("block", "variant", "fp")
        return v.repartition(n, "block", "variant").sortWithinPartitions("block", "variant", "fp").mapInArrow(run, out)

    found = checkpointed(dealt(balls, fps, _candidate_links).distinct())
    crowded = found.where("kind = 1").select(F.col("u").alias("fp"))
    full = dealt([(0, every, _masks(list(range(BITS)), 2))], crowded, _ball_links)
    return found.where("kind = 0").select("u", "v").union(full.select("u", "v"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per input row: ``(id, fp, component, is_first)``.

    Rows whose fingerprints differ in at most four bits are linked; a component
    is named by its smallest id. Equal fingerprints, zero included, are linked.
    ``is_first`` marks the row that carries that smallest id. Null ids take part
    in links but never name a component that has another id. Repeated rows are
    all returned. Empty tables give an empty result. Texts are read whole, however long;
    other columns are not read, whatever their names.
    """
    sig = checkpointed(fingerprints(df, id_col, text_col, width))
    fps = checkpointed(sig.groupBy("fp").agg(F.min("id").alias("least")))
    comps = connected_components(fingerprint_links(fps.select("fp")))
    named = fps.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = join_on_hidden_key(named.select("fp", "root"), roots, "root").select("fp", "component")
    out = join_on_hidden_key(sig, by_fp, "fp")
    return out.select("id", "fp", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("is_first"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from quern.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
