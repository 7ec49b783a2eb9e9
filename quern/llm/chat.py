"""Chat formatting with minimum-cost role repair.

A legal conversation is a path of an automaton: optionally one system turn, then user
and assistant in alternation, beginning with the user and ending with the assistant.
Every turn of the input is merged into the turn before it, relabelled or kept, and
empty turns may be inserted before it; each choice has a cost and dynamic programming
finds the cheapest legal path. Of paths of equal cost the one whose states, read from
the end, come first is taken.

Spark sorts the turns by conversation over range partitions sized by bytes, so a long
conversation spreads over as many tasks as it needs. Costs of a stretch of turns are a
small matrix between states, and matrices compose (minimum of sums) as the turns do.
One pass reduces the two conversations at the borders of every partition to such
matrices; the driver joins these (two rows a partition) into border states. A second
pass decodes all conversations of a partition together, turn by turn, and renders them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, only, table

ROLES = ("system", "user", "assistant")
#: States: before the first turn, and after a turn of each role.
STATES = ("start", *ROLES)
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs in halves, so that sums are exact.
MERGE, MERGE_OTHER, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 6, 4, 1, 5
UNIT = 0.5
#: Text bytes of a sorted partition: what a task may hold of one conversation.
PART_BYTES = 32_000_000
#: Conversations up to this long are decoded side by side.
SHORT = 64
# Names under which data sets write the three roles.
ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "customer": "user", "assistant": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "agent": "assistant"}
_INF = 1 << 40


def _choices() -> dict[tuple[int, int, int], tuple[int, str, tuple[int, ...]]]:
    """(role code, from, to) to the cheapest (cost, action, inserted roles)."""
    found: dict[tuple[int, int, int], list] = {}
    for code, s in itertools.product(range(4), range(4)):  # code 0: a role that is not known
        if s != START:
            cost = MERGE if code == s else MERGE_OTHER if code else MERGE + RELABEL_UNKNOWN
            found.setdefault((code, s, s), []).append((cost, 0, "merge", ()))
        paths = [((), s)]
        for _ in range(3):  # insertions before the turn
            for inserted, at in paths:
                for to in NEXT[at]:
                    cost = (0 if code == to else RELABEL if code else RELABEL_UNKNOWN) + INSERT * len(inserted)
                    action = "_".join([*(["insert"] if inserted else []), *(["relabel"] if code != to else [])]) or "keep"
                    found.setdefault((code, s, to), []).append((cost, len(inserted), action, inserted))
            paths = [((*inserted, to), to) for inserted, at in paths for to in NEXT[at]]
    return {key: (best[0], best[2], best[3]) for key, options in found.items() for best in [min(options)]}


_CHOICES = _choices()
_COSTS = np.full((4, 4, 4), _INF, np.int64)
for _key, _choice in _CHOICES.items():
    _COSTS[_key] = _choice[0]
_MERGES = np.array([[[_CHOICES.get((c, a, b), (0, ""))[1] == "merge" for b in range(4)] for a in range(4)] for c in range(4)])
#: Empty turns that close a conversation after each state, and their cost.
_CLOSING = ((), (USER, ASSISTANT), (ASSISTANT,), ())
_END = np.array([INSERT * len(c) for c in _CLOSING], np.int64)
_RANKS = np.tile(np.arange(4)[:, None], (1, 4))
_IDENTITY = np.where(np.eye(4, dtype=bool), 0, _INF).astype(np.int64)


def _empty_turns(roles: tuple[int, ...]) -> str:
    return "".join(f"<|{ROLES[r - 1]}|>\n<|end|>\n" for r in roles)


def _names() -> tuple[list[str], list[str]]:
    """Action and opening text of every (code, from, to), flattened."""
    actions, opened = [], []
    for key in itertools.product(range(4), range(4), range(4)):
        _, action, inserted = _CHOICES.get(key, (0, "", ()))
        actions.append(action)
        opened.append("\n" if action == "merge" else f"{_empty_turns(inserted)}<|{ROLES[key[2] - 1]}|>\n")
    return actions, opened


_ACTIONS, _OPENED = _names()
#: Closing text: none where the next turn merges, else the end mark and the empty turns after each state.
_CLOSED = ["", "<|end|>\n", *(f"<|end|>\n{_empty_turns(c)}" for c in _CLOSING)]


def _composed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks of stretches (n, 4, 4) followed by others.

    ``rank[s, t]`` orders the cheapest paths into ``t`` by their states read from the end;
    with it, composition keeps the first of equal paths.
    """
    (cost_a, rank_a), (cost_b, rank_b) = a, b
    total = cost_a[:, :, :, None] + cost_b[:, None, :, :]
    middle = (total * 4 + rank_b[:, None, :, :]).argmin(axis=2)
    cost = np.take_along_axis(total, middle[:, :, None, :], 2)[:, :, 0, :]
    n = np.arange(len(cost))[:, None, None]
    s, t = np.arange(4)[None, :, None], np.arange(4)[None, None, :]
    order = rank_b[n, middle, t] * 4 + rank_a[n, s, middle]
    rank = (order[:, None, :, :] < order[:, :, None, :]).sum(axis=2)
    return np.minimum(cost, _INF), rank


def _reduced(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and rank matrix of a stretch, by pairs of halves."""
    cost, rank = _COSTS[codes], np.broadcast_to(_RANKS, (len(codes), 4, 4))
    while len(cost) > 1:
        even = len(cost) // 2 * 2
        both = _composed((cost[0:even:2], rank[0:even:2]), (cost[1:even:2], rank[1:even:2]))
        cost, rank = (np.concatenate([x, y[even:]]) for x, y in zip(both, (cost, rank), strict=True))
    return (cost[0], rank[0]) if len(cost) else (_IDENTITY, _RANKS)


def _decoded(codes: np.ndarray, first: np.ndarray, size: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before and after every turn of stretches; an end of -1 is that of a whole conversation."""
    before, after = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    order = np.argsort(-size, kind="stable")
    long = int((size > SHORT).sum())
    for which in [*(order[i : i + 1] for i in range(long)), order[long:]]:
        if not len(which):
            continue
        n, height = len(which), int(size[which[0]])
        live = [int(np.searchsorted(-size[which], -t, side="left")) for t in range(height)]
        cost = np.full((n, 4), _INF, np.int64)
        cost[np.arange(n), begin[which]] = 0
        back = np.zeros((height, n, 4), np.int8)
        for t, m in enumerate(live):
            total = cost[:m, :, None] + _COSTS[codes[first[which[:m]] + t]]
            back[t, :m] = total.argmin(axis=1)
            cost[:m] = np.minimum(total.min(axis=1), _INF)
        state = np.where(end[which] >= 0, end[which], (cost + _END).argmin(axis=1))
        for t in range(height - 1, -1, -1):
            m = live[t]
            rows = first[which[:m]] + t
            after[rows] = state[:m]
            state[:m] = back[t, np.arange(m), state[:m]]
            before[rows] = state[:m]
    return before, after


def _changes(conv: pa.Array) -> np.ndarray:
    """Whether each row after the first begins another conversation."""
    a, b = conv.slice(0, len(conv) - 1), conv.slice(1)
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return differ.to_numpy(zero_copy_only=False)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of a partition (one row if they are the same)."""
    runs: list[dict] = []  # of at most two conversations: the first, and the one that goes on

    def extend(run: dict, codes: np.ndarray) -> None:
        if not run["n"]:
            run["code"], rest = int(codes[0]), codes[1:]
        else:
            rest = codes
        run["n"] += len(codes)
        more = _reduced(rest)
        both = _composed(tuple(x[None] for x in run["rest"]), tuple(x[None] for x in more))
        run["rest"] = (both[0][0], both[1][0])

    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, codes = batch.column(0), batch.column(1).to_numpy()
        schema = conv.type
        starts = np.append(0, np.flatnonzero(_changes(conv)) + 1)
        stops = np.append(starts[1:], len(codes))
        goes_on = bool(runs) and conv[0].as_py() == runs[-1]["conv"]
        for nth in sorted({0, len(starts) - 1}):
            if nth or not goes_on:
                # runs between the first and the last are whole and of no concern here
                runs = [*runs[:1], {"conv": conv[int(starts[nth])].as_py(), "n": 0, "rest": (_IDENTITY, _RANKS)}]
            extend(runs[-1], codes[starts[nth] : stops[nth]])
    if runs:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(runs), pa.int32()), pa.array(range(len(runs)), pa.int32()), pa.array([r["conv"] for r in runs], schema), pa.array([r["n"] for r in runs], pa.int64()),
                pa.array([r["code"] for r in runs], pa.int32()), pa.array([r["rest"][0].ravel().tolist() for r in runs], pa.list_(pa.int64())), pa.array([r["rest"][1].ravel().tolist() for r in runs], pa.list_(pa.int64())),
            ],
            ["part", "nth", "conv", "n", "code", "cost", "rank"],
        )


def _joined(rows: list) -> dict[tuple[int, int], tuple[int, int, int, bool]]:
    """(partition, nth) to (state before, state after, or -1 at the end, turns before, next turn merges).

    Only conversations that lie in several partitions are listed.
    """
    out = {}
    chains = [list(g) for _, g in itertools.groupby(rows, key=lambda r: (r.conv is None, r.conv))]
    for chain in chains:
        if len(chain) < 2:
            continue
        heads = [(_COSTS[r.code][None], _RANKS[None]) for r in chain]
        rests = [tuple(np.array(x, np.int64).reshape(1, 4, 4) for x in (r.cost, r.rank)) for r in chain]
        wholes = [_composed(h, r) for h, r in zip(heads, rests, strict=True)]
        cost = [np.where(np.arange(4) == START, 0, _INF)]
        for c, _ in wholes:
            cost.append(np.minimum((cost[-1][:, None] + c[0]).min(axis=0), _INF))
        state, merges = int((cost[-1] + _END).argmin()), False
        turns = np.cumsum([0, *(r.n for r in chain)]).tolist()
        for i in range(len(chain) - 1, -1, -1):
            c, rank = wholes[i]
            begin = int(((cost[i] + c[0][:, state]) * 4 + rank[0][:, state]).argmin())
            out[chain[i].part, chain[i].nth] = (begin, state if i < len(chain) - 1 else -1, turns[i], merges)
            # the state after the first turn tells whether that turn merges
            rest, order = rests[i]
            second = int(((_COSTS[chain[i].code][begin] + rest[0][:, state]) * 4 + order[0][:, state]).argmin())
            merges, state = bool(_MERGES[chain[i].code, begin, second]), begin
    return out


def _rendered(known: dict[tuple[int, int], tuple[int, int, int, bool]]):
    """Decode the conversations of a partition; what is known of its borders comes from ``_joined``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done = TaskContext.get().partitionId(), [], 0

        def out(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done
            rows = rows.combine_chunks().to_batches()[0]
            conv, codes = rows.column(0), rows.column(1).to_numpy().astype(np.int64)
            first = np.append(0, np.flatnonzero(_changes(conv)) + 1)
            size = np.diff(np.append(first, len(codes)))
            n = len(first)
            begin, end, turns, merges = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
            for i in {0, n - 1}:
                # the last conversation of a partition is its second border run, unless it is also its first
                nth = 0 if done + i == 0 else 1 if last and i == n - 1 else -1
                begin[i], end[i], turns[i], merges[i] = known.get((part, nth), (START, -1, 0, False))
            done += n
            before, after = _decoded(codes, first, size, begin, end)
            key = (codes * 4 + before) * 4 + after
            stops = first + size - 1
            goes_on = np.append(_MERGES.ravel()[key[1:]], False)
            goes_on[stops] = merges
            closed = np.where(goes_on, 0, 1)
            whole = stops[end < 0]
            closed[whole] = 2 + after[whole]
            cost = _COSTS.ravel()[key]
            cost[whole] += _END[after[whole]]
            place = np.arange(len(codes)) - np.repeat(first - turns, size)
            words = [pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(names, pa.string())).cast(pa.string()) for at, names in ((after - 1, ROLES), (key, _ACTIONS), (key, _OPENED), (closed, _CLOSED))]
            arrays = [conv, *rows.columns[2:], pa.array(place), words[0], words[1], pa.array(cost * UNIT), words[2], words[3]]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", *rows.schema.names[2:], "place", "new_role", "action", "cost", "opened", "closed"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            edge = held[-2].column(0).slice(len(held[-2]) - 1).combine_chunks() if len(held) > 1 else None
            cuts = np.flatnonzero(_changes(batch.column(0)))
            same = edge is not None and batch.column(0)[0].as_py() == edge[0].as_py()
            at = int(cuts[-1]) + 1 if len(cuts) else 0 if edge is not None and not same else None
            if at is not None:
                whole = pa.concat_tables([*held[:-1], held[-1].slice(0, at)])
                held = [held[-1].slice(at)]
                yield from out(whole, False)
        if held:
            yield from out(pa.concat_tables(held), True)

    return run


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, place, role, new_role, action, cost, rendered)``, one row per input row.

    Joined in order of ``place`` (from 0), a conversation's ``rendered`` parts are its text:
    every turn as ``<|role|>`` and a line feed, the text, ``<|end|>`` and a line feed; a
    merged turn continues the turn before it after a line feed, inserted turns are empty.
    A null or empty text renders empty and an unknown or null role may take any role at
    a small cost. Turns are placed by number, a null number before all others; turns with
    equal numbers by a hash of the text, then role. Rows that repeat are turns of their
    own. A null conversation is one conversation. Texts are never cut, however long. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = only(df, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    role = F.coalesce(F.element_at(alias, F.coalesce(F.lower(F.trim("role")), F.lit(""))), F.lit(""))
    code = sum((F.when(role == r, i + 1).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0)).cast("int")
    # the last key splits rows that repeat without end
    rows = rows.select("conv", code.alias("code"), F.col("turn").cast("bigint").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("hash"), F.rand(5).alias("any"))
    keys = ["conv", "turn", "hash", "role", "any"]
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    placed = checkpointed(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("hash", "any"))
    kind = placed.schema["conv"].dataType.simpleString()
    borders = placed.select("conv", "code").mapInArrow(_borders, f"part int, nth int, conv {kind}, n bigint, code int, cost array<bigint>, rank array<bigint>")
    # at most two rows a partition
    known = _joined(sorted(borders.collect(), key=lambda r: (r.part, r.nth)))
    out = placed.mapInArrow(_rendered(known), f"conv {kind}, turn bigint, role string, text string, place bigint, new_role string, action string, cost double, opened string, closed string")
    return out.select("conv", "turn", "place", "role", "new_role", "action", "cost", F.concat("opened", "text", "closed").alias("rendered"))


def op9_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")
