"""Substring deduplication on a compacted De Bruijn graph of words.

The graph's edges are windows of ``WINDOW`` consecutive words. Writing every edge
out would shuffle a row per word, so edges are compacted before they move:

1. Every edge belongs to the bucket of its minimizer, the ``K``-word sequence of
   least hash in it. Consecutive edges of one document that share a minimizer are
   one nonbranching piece of path (a super-k-mer) and travel as one row of hashes
   and source coordinates, about a sixth of the rows.
2. Inside a bucket, equal pieces collapse on their first source coordinates:
   every later copy is a repeated path as a whole. Copies inside one map batch
   collapse before the shuffle.
3. A bucket with several different pieces is where paths branch. Only there are
   the pieces' first copies opened into edges again: their coordinates join the
   documents, the edges are hashed from the words at these coordinates and the
   first source of each edge is found.
4. Joined on the document, the repeated pieces and edges unite into long spans.

Every word has two hashes, by different functions and seeds. Minimizers and edges use
the first; a piece or edge is a repeat only where both, taken over all its words at its
source coordinates, agree. So words that collide in one of them do not pass
for each other.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, only, table

WINDOW, K = 20, 10
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_TURNS = tuple(_U(pow(int(b), -1, 1 << 64)) for b in _BASES)
_OCC = "m bigint, b bigint, id bigint, tie bigint, lo bigint"
_FOUND = "id bigint, tie bigint, mark bigint"
#: Words whose hashes a worker remembers.
_WORDS = 400_000
#: Words hashed at once, and so the order of a task's extra memory.
_SPAN = 1 << 20


class _WordHashes(dict):
    """Numbers words; their two hashes lie in ``pairs``."""

    def __init__(self):
        super().__init__()
        self.pairs = (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        for hashes, value in zip(self.pairs, _two_hashes(word), strict=True):
            hashes.append(value)
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        """Both hashes of every word of a text, as two rows."""
        if len(self) > _WORDS:
            self.clear()
            self.pairs = (array("Q"), array("Q"))
        words = (text or b"").split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.stack([np.frombuffer(h, _U)[at] for h in self.pairs]) if len(words) else np.zeros((2, 0), _U)


def _two_hashes(word: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(word, 7), xxhash.xxh3_64_intdigest(word, 1009)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Rolling:
    """Hashes of any word interval of one document, by prefix sums modulo 2^64.

    ``of(0, ..)`` is over the words' first hashes, ``of(1, ..)`` over their second ones.
    """

    _tables: list = [np.zeros(0, _U)] * 4

    def __init__(self, words: np.ndarray):
        n = words.shape[1] + 1
        if len(_Rolling._tables[0]) < n:
            size = max(n, 1 << 15)
            _Rolling._tables = [_powers(x, size) for x in (*_BASES, *_TURNS)]
        self.up = [t[:n] for t in _Rolling._tables[:2]]
        self.sums = [np.concatenate([np.zeros(1, _U), np.cumsum(w * t[: n - 1], dtype=_U)]) for w, t in zip(words, _Rolling._tables[2:], strict=True)]

    def of(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[stop] - s[start]) * self.up[which][start])


def _pieces(words: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(minimizer, piece hash, first edge, last edge) of each piece of one document."""
    n = words.shape[1] - WINDOW + 1
    if n < 1:
        return None
    roll = _Rolling(words)
    at = np.arange(words.shape[1] - K + 1)
    mers = roll.of(0, at, at + K)
    width = WINDOW - K + 1
    least = np.empty(n, np.int64)
    for a in range(0, n, _SPAN):
        part = np.lib.stride_tricks.sliding_window_view(mers[a : min(n, a + _SPAN) + width - 1], width)
        least[a : a + len(part)] = part.argmin(axis=1) + np.arange(a, a + len(part))
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    lo = np.concatenate([[0], cuts])
    hi = np.concatenate([cuts, [n]]) - 1
    at = least[lo]
    shape = ((at - lo) * 64 + (hi - lo)).astype(_U)
    # both hashes of all the piece's words, and where its minimizer stands
    piece = _mix(roll.of(1, lo, hi + WINDOW) ^ _mix(roll.of(0, lo, hi + WINDOW) + _mix(shape + _U(1))))
    return mers[at], piece, lo, hi


def _mark(flag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """First edge, number of further edges and a flag in one long that sorts by first edge."""
    return (lo.astype(np.int64) << 32) | ((hi - lo).astype(np.int64) << 1) | flag


def _unmark(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = mark >> 32
    return mark & 1, lo, lo + ((mark & 0xFFFFFFFF) >> 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each document; later copies inside the batch are settled at once."""
    cache = _WordHashes()

    def flush(found):
        m, b, lo, hi, doc, tie = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lo, tie, doc, b, m))
        m, b, lo, hi, doc, tie = (x[order] for x in (m, b, lo, hi, doc, tie))
        again = np.zeros(len(m), bool)
        again[1:] = (m[1:] == m[:-1]) & (b[1:] == b[:-1])
        # Of a run of equal pieces only the first goes to its bucket. Identical rows share
        # coordinates and are no copies of one another.
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(m))))
        same = again & (doc == doc[first]) & (tie == tie[first]) & (lo == lo[first])
        go = ~same
        again = again[go]
        # settled rows only pass through, so spread them over all tasks
        key = np.where(again, _mix(doc[go].view(_U) + lo[go].astype(_U) * _U(31)), m[go])
        where = _mark(again, lo[go], hi[go])
        return pa.RecordBatch.from_arrays([_signed(key), _signed(np.where(again, _U(0), b[go])), pa.array(doc[go]), pa.array(tie[go]), pa.array(where)], ["m", "b", "id", "tie", "lo"])

    for batch in batches:
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found, rows = [], 0
        for i, text in enumerate(batch.column(2).cast(pa.binary())):
            got = _pieces(cache.of(text.as_py()))
            if got is None:
                continue
            m, b, lo, hi = got
            found.append((m, b, lo, hi, np.full(len(m), ids[i], np.int64), np.full(len(m), ties[i], np.int64)))
            rows += len(m)
            if rows > _SPAN:
                yield flush(found)
                found, rows = [], 0
        if found:
            yield flush(found)


class _Runs:
    """Runs of equal keys in sorted rows that arrive batch by batch.

    ``of`` gives (row begins a run, row is a later copy). Rows with the first
    row's coordinates are the same source seen twice and are no copies.
    """

    def __init__(self):
        self.key, self.source = None, None

    def of(self, keys: list[np.ndarray], source: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new = np.zeros(len(keys[0]), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = self.key != tuple(k[0] for k in keys)
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        goes_on = np.cumsum(new) == 0
        same = np.ones(len(new), bool)
        for i, s in enumerate(source):
            same &= s == (s[head] if self.source is None else np.where(goes_on, self.source[i], s[head]))
        if not goes_on[-1]:
            self.source = tuple(s[head[-1]] for s in source)
        self.key = tuple(k[-1] for k in keys)
        return new, ~new & ~same


def _bucket_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (m, b, id, tie, lo): flag 0 repeated pieces, flag 1 pieces to open."""
    runs, last_m = _Runs(), None
    held = None  # the piece of the newest bucket, while it is the bucket's only one

    def out(kind, columns):
        doc, tie, mark = (np.ascontiguousarray(c) for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tie), pa.array((mark & ~1) | kind)], ["id", "tie", "mark"])

    for batch in batches:
        m, b, *where = (c.to_numpy() for c in batch.columns)
        passing = (where[2] & 1) == 1
        if passing.any():
            yield out(0, [x[passing] for x in where])
            m, b, *where = (x[~passing] for x in (m, b, *where))
        if not len(m):
            continue
        new, copies = runs.of([m, b], where)
        new_m = np.ones(len(m), bool)
        new_m[1:] = m[1:] != m[:-1]
        new_m[0] = m[0] != last_m
        last_m = m[-1]
        if copies.any():
            yield out(0, [x[copies] for x in where])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        bucket = np.cumsum(new_m[first])  # 0: the bucket in which the last batch ended
        sizes = np.bincount(bucket)
        send = (bucket == 0) | (sizes[bucket] > 1)
        columns = [x[first[send]] for x in where]
        if sizes[0] and held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if sizes[0] or bucket[-1]:
            held = None
        if bucket[-1] and sizes[-1] == 1:
            held = [x[first[-1:]] for x in where]
        if len(columns[0]):
            yield out(1, columns)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces: one row per edge, hashed from the words at its coordinates."""
    cache = _WordHashes()

    def flush(found):
        h1, h2, doc, tie, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(doc), pa.array(tie), pa.array(at.astype(np.int32))], ["h1", "h2", "id", "tie", "lo"])

    for batch in batches:
        ids, ties, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        found, rows = [], 0
        for i, text in enumerate(batch.column(2).cast(pa.binary())):
            kind, lo, hi = _marks(marks[i])
            lo, hi = lo[kind == 1], hi[kind == 1]
            at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
            roll = _Rolling(cache.of(text.as_py()))
            found.append((roll.of(0, at, at + WINDOW), roll.of(1, at, at + WINDOW), np.full(len(at), ids[i], np.int64), np.full(len(at), ties[i], np.int64), at))
            rows += len(at)
            if rows > _SPAN:
                yield flush(found)
                found, rows = [], 0
        if found:
            yield flush(found)


def _marks(scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = scalar is not None and scalar.is_valid
    return _unmark(scalar.values.to_numpy() if known else np.zeros(0, np.int64))


def _later_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, id, tie, lo): every row after the first of its edge."""
    runs = _Runs()
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, tie, lo = (c.to_numpy() for c in batch.columns)
        _, copies = runs.of([h1, h2], [doc, tie, lo])
        if copies.any():
            at = lo[copies]
            yield pa.RecordBatch.from_arrays([pa.array(doc[copies]), pa.array(tie[copies]), pa.array(_mark(0, at, at))], ["id", "tie", "mark"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [batch.column(2), batch.column(3)]
        total, gone, digests = [], [], []
        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            words = (text.as_py() or b"").split()
            steps = np.zeros(len(words) + 1, np.int64)
            for column in marks:
                kind, lo, hi = _marks(column[i])
                lo, hi = lo[kind == 0], hi[kind == 0]
                np.add.at(steps, lo, 1)
                np.add.at(steps, hi + WINDOW, -1)
            covered = np.cumsum(steps[:-1]) > 0
            n = int(covered.sum())
            kept = words if not n else [words[j] for j in np.flatnonzero(~covered).tolist()]
            total.append(len(words))
            gone.append(n)
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def _spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, tie, text, whole, edges)``: the documents with their repeated windows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a null id orders before all others
    docs = only(df, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), "text")
    # only where an id repeats are rows told apart by their text
    unique = docs.groupBy("id").count().where("count > 1").isEmpty()
    docs = docs.select("id", (F.lit(0) if unique else F.xxhash64("text")).cast("bigint").alias("tie"), "text")
    pieces = docs.mapInArrow(_occurrences, _OCC)
    found = pieces.repartition(n, "m").sortWithinPartitions("m", "b", "id", "tie", "lo").mapInArrow(_bucket_stream, _FOUND)
    per_doc = checkpointed(found.groupBy("id", "tie").agg(F.collect_list("mark").alias("marks")))
    opened = per_doc.where(F.exists("marks", lambda x: x.bitwiseAND(F.lit(1)) == 1))
    edges = docs.join(opened, ["id", "tie"]).select("id", "tie", "text", "marks").mapInArrow(_edges, "h1 bigint, h2 bigint, id bigint, tie bigint, lo int")
    later = edges.repartition(n, "h1", "h2").sortWithinPartitions("h1", "h2", "id", "tie", "lo").mapInArrow(_later_edges, _FOUND)
    per_doc_edges = later.groupBy("id", "tie").agg(F.collect_list("mark").alias("edges"))
    both = per_doc.withColumnRenamed("marks", "whole").join(per_doc_edges, ["id", "tie"], "full")
    return docs.join(both, ["id", "tie"], "left").select("id", "text", "whole", "edges")


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` for each row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a null or empty text has none. A
    word goes if a window of 20 words that covers it has the same words as a
    window that starts earlier: in a smaller id, or earlier in the same row.
    Windows are judged on the input. Rows repeated with one id and text count as
    one document and get equal results; rows with one id and different texts are
    ordered by a hash of the text. A null id orders first and returns as null. Texts are
    read whole, however long. An empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    out = _spans(df, id_col, text_col).mapInArrow(_cleaned, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumn("id", F.when(F.col("id") != -(1 << 63), F.col("id")))


def op2_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: DuckDB's equivalent: every window in full, for tables of a size that bears it.
ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as words from documents),
win as (select doc_id, unnest(range(len(words) - 19)) as i, words from w where len(words) >= 20),
named as (select doc_id, i, array_to_string(list_slice(words, i + 1, i + 20), ' ') as seq from win),
later as (select doc_id, i from (select *, row_number() over (partition by seq order by doc_id, i) as nth from named) where nth > 1),
pos as (select doc_id, unnest(words) as word, unnest(range(len(words))) as i from w),
marked as (select p.doc_id, p.i, word, max(case when l.i is not null then 1 else 0 end) over (partition by p.doc_id order by p.i rows between 19 preceding and current row) as gone
           from pos p left join later l on l.doc_id = p.doc_id and l.i = p.i),
kept as (select doc_id, count(*) as n, sum(gone) as removed, string_agg(word, ' ' order by i) filter (gone = 0) as text from marked group by 1)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (doc_id)"""
