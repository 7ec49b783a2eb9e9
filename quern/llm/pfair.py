"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

A source with weight w runs its block k in the window [k / w, (k + 1) / w): the
block is released at floor(k / w) and due at ceil((k + 1) / w). Earliest deadline
first over released blocks is feasible whenever the weights add up to one, and
then every source is within one block of its share at every moment.

Weights are taken as exact fractions, so the schedule repeats after the sum of the
least integers in their ratio. One such frame is scheduled on the driver, or as many
slots as there are blocks left, if these are fewer. When a source runs out, a new
phase begins with the weights of the others scaled to one and a frame of its own, so
nothing is dropped; there are at most as many phases as named sources. A block's slot then follows from arithmetic on its
number, without a global order or a task that sees a whole source.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, only, table

REST = "(rest)"
BLOCK_CHARS = 1 << 16
#: Rows per bucket of the running totals inside one source.
_BUCKET_ROWS = 4096

#: Target weights of op8 and the pipeline; sources not named share the weight of REST.
TARGET = {**{f"src{i}": 2.0 if i < 5 else 1.0 for i in range(20)}, REST: 1.0}


def exact_shares(weights: dict[str, float]) -> dict[str, int]:
    """Slots per frame without rounding: the least integers in the ratio of the weights as written."""
    exact = {g: Fraction(str(w)) for g, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    slots = {g: int(x * scale) for g, x in exact.items()}
    common = math.gcd(*slots.values())
    return {g: n // common for g, n in slots.items()}


def shares(weights: dict[str, float], frame: int) -> dict[str, int]:
    """Slots per frame, at least one for each source, by largest remainder."""
    if len(weights) > frame:
        raise ValueError("more sources than slots in a frame")
    total = sum(weights.values())
    exact = {g: frame * w / total for g, w in weights.items()}
    out = {g: max(1, int(x)) for g, x in exact.items()}
    order = sorted(weights, key=lambda g: (out[g] - exact[g], g))
    i = 0
    while (short := frame - sum(out.values())) != 0:
        g = order[i % len(order)] if short > 0 else max(sorted(out), key=out.get)
        out[g] += 1 if short > 0 else -1
        i += 1
    return out


def schedule_frame(slots: dict[str, int], frame: int, until: int | None = None) -> dict[str, list[int]]:
    """Slot of each source's k-th block in one frame, or its first ``until`` slots: earliest deadline first."""
    waiting = [(0, -(-frame // n), g, 0) for g, n in slots.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {g: [] for g in slots}
    for now in range(frame if until is None else until):
        while waiting and waiting[0][0] <= now:
            _, due, g, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, g, k))
        _, g, k = heapq.heappop(ready)
        out[g].append(now)
        k, n = k + 1, slots[g]
        if k < n:
            heapq.heappush(waiting, (k * frame // n, -(-(k + 1) * frame // n), g, k))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], frame: int | None = None) -> tuple[list[dict], list[dict]]:
    """Phases (which blocks of which source run from which slot) and their frames."""
    done = dict.fromkeys(blocks, 0)
    left = {g: n for g, n in blocks.items() if n}
    base, spans, cells = 0, [], []
    number = 0
    while left:
        mine = {g: weights[g] for g in left}
        slots = shares(mine, frame) if frame else exact_shares(mine)
        period = sum(slots.values())
        # a phase ends when a source runs out, at the latest when all blocks have run
        until = min(period, sum(left.values()))
        table_ = schedule_frame(slots, period, until)
        if until < period:
            end = min(table_[g][n - 1] + 1 for g, n in left.items() if len(table_[g]) >= n)
        else:
            end = min((n - 1) // slots[g] * period + table_[g][(n - 1) % slots[g]] + 1 for g, n in left.items())
        for g, n in list(left.items()):
            used = end // period * slots[g] + sum(s < end % period for s in table_[g])
            if used:
                turn = min(slots[g], used)
                spans.append({"phase": number, "grp": g, "first": done[g], "until": done[g] + used, "n": turn, "period": min(period, end), "base": base})
                # windows in whole numbers; a due slot beyond any table is written as 2^62
                cells += [
                    {"phase": number, "grp": g, "k": k, "cell": s, "release": k * period // slots[g], "due": min(1 << 62, -(-(k + 1) * period // slots[g]))}
                    for k, s in enumerate(table_[g][:turn])
                ]
            done[g] += used
            left[g] -= used
            if not left[g]:
                del left[g]
        base += end
        number += 1
    return spans, cells


def _small(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, frame: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(id, grp, block, slot, place, release, due)`` for each row; order by slot, place.

    A source's rows are ordered by a hash of their id and laid end to end; every
    ``block_chars`` characters (a row counts one more than its text) begin a
    block, and a row runs with the block in which it begins. Sources without a
    weight, null included, mix as one source named ``(rest)``. Null texts count
    as empty. Repeated rows follow one another. ``release`` and ``due`` are slots,
    from the exact weights; only a ``frame`` that is given rounds them to 1 / ``frame``.
    An empty table gives an empty result; weights must be positive. A very long text fills
    blocks of its own; other columns are not read, whatever their names.
    """
    weights = dict(weights or TARGET)
    weights.setdefault(REST, min(weights.values()))
    if min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    spark = df.sparkSession
    named = F.col("source").isin(*[g for g in weights if g != REST])
    rows = only(df, id=id_col, text=text_col, source=source_col).select(
        "id", F.when(named, F.col("source")).otherwise(REST).alias("grp"), F.xxhash64("id").alias("h"), (F.coalesce(F.char_length("text"), F.lit(0)) + 1).cast("bigint").alias("size")
    )
    # repeated rows become one row with a count, so that no id can fill a bucket
    rows = checkpointed(rows.groupBy("grp", "h", "id", "size").agg(F.count("*").alias("copies")))
    bits = max(0, (rows.count() // _BUCKET_ROWS).bit_length())
    bucket = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy("grp", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("total"))
    sums = checkpointed(sums.withColumn("before", F.sum("total").over(Window.partitionBy("grp").orderBy("bucket")) - F.col("total")))
    # at most one row for each named weight
    blocks = {r.grp: (r.total - 1) // block_chars + 1 for r in sums.groupBy("grp").agg(F.sum("total").alias("total")).collect()}
    spans, cells = phases(blocks, weights, frame)

    inside = Window.partitionBy("grp", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("size") * F.col("copies")
    placed = rows.withColumn("inside", F.sum(weight).over(inside) - weight).join(sums.select("grp", "bucket", "before"), ["grp", "bucket"])
    placed = placed.select("id", "grp", "size", (F.col("before") + F.col("inside")).alias("start"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    placed = placed.withColumn("place", F.col("start") + F.col("copy") * F.col("size")).withColumn("block", F.floor(F.col("place") / F.lit(block_chars)))
    # (sources + 1) phases of one frame each: the sum of the integer weights, or the blocks left where these are fewer
    span = F.broadcast(_small(spark, spans, "phase int, grp string, first bigint, until bigint, n bigint, period bigint, base bigint").withColumnRenamed("grp", "span_grp"))
    cell = F.broadcast(_small(spark, cells, "phase int, grp string, k bigint, cell bigint, release bigint, due bigint").withColumnRenamed("grp", "cell_grp").withColumnRenamed("phase", "cell_phase"))
    placed = placed.join(span, F.expr("grp = span_grp and block >= first and block < until"))
    placed = placed.withColumn("nth", F.col("block") - F.col("first")).withColumn("turn", F.floor(F.col("nth") / F.col("n"))).withColumn("kk", F.col("nth") % F.col("n"))
    placed = placed.join(cell, F.expr("grp = cell_grp and phase = cell_phase and kk = k"))
    at = F.col("base") + F.col("turn") * F.col("period")
    return placed.select("id", "grp", "block", (at + F.col("cell")).alias("slot"), "place", (at + F.col("release")).alias("release"), (at + F.col("due")).alias("due"))


def placed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``df``, none dropped, with ``_slot`` and ``_place`` of the mix."""
    # rows are named by id, source and text, so that rows of null or repeated ids keep slots of their own;
    # equal rows stay together and come out once each
    keyed = df.withColumn("_mix_key", F.xxhash64(id_col, source_col, text_col))
    order = mix(keyed, "_mix_key", text_col, source_col, **how).groupBy("id").agg(F.min(F.struct("slot", "place")).alias("at"))
    order = order.select(F.col("id").alias("_mix_id"), F.col("at.slot").alias("_slot"), F.col("at.place").alias("_place"))
    return keyed.join(order, F.expr("_mix_key = _mix_id")).drop("_mix_key", "_mix_id")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``df`` in the order of the mix, none dropped."""
    return placed_documents(df, id_col, **how).orderBy("_slot", "_place").select(*df.columns)


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("grp", "source_group")
