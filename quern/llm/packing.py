"""Packing documents into fixed windows by lexical retrieval.

1. One pass tokenises: ids are not moved, but each document's length, the CRC-32 of
   every ``STEP`` tokens and its word counts are. Words are named by 32 bits of hash,
   which only scores depend on.
2. Documents are dealt out by a lexical sketch (the two least word hashes), so that
   documents of like words meet. A sketch that more than ``HOT_ROWS`` rows share is
   dealt over as many places as it needs. Tasks are sized by bytes.
3. A task cuts its sorted rows into shards of bounded size. Each shard is a BM25
   inverted index over all its documents, weighted by document frequencies, number and
   mean length of all documents, which are counted once before. Common words of a shard
   are rows of a matrix, so that their share of many seeds' scores is one product; the
   others are posting lists. Whole windows of a long document are
   sequences by themselves; what remains of it seeds or joins a window: the seed's
   words retrieve unused neighbours, best first, which fill the window; the last one
   is cut (at a multiple of ``STEP`` tokens) and its rest stays unused. What a shard
   leaves in a window that is not full is carried to the next shard of the task.

Where rows have slots of a mix, ranges of slots take the place of sketches: a shard lies
in one range, rows seed in the order of the mix, no window spans two ranges and the
sequences are numbered by range.

A piece's CRC-32 follows from those of its parts, as CRC is linear, so no text is
tokenised twice.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, join_on_hidden_key, only, table
from quern.llm.word_bpe import Merges

LENGTH, STEP, END = 2048, 16, 1
SHARD_DOCS, SHARD_POSTINGS = 4000, 2_000_000
#: Documents, and bytes of word counts and sums, per task of the packing stage.
TASK_DOCS, TASK_BYTES = 20_000, 24_000_000
#: Rows of one sketch that meet in one place.
HOT_ROWS = 256
#: Hot sketches that may be broadcast; more are joined by shuffle.
HOT_BROADCAST = 50_000
#: Slots of a mix that are packed together, and such ranges per task.
RANGE_SLOTS, TASK_RANGES = 100, 4
K1, B = 1.2, 0.75
#: Parts a worker remembers, and bytes of text it takes at a time.
_WORDS, _CHUNK = 500_000, 4_000_000
#: Words that at least one in so many documents of a shard hold are scored by matrix product.
_COMMON = 8
#: Seeds whose common words are scored at a time.
_SEEDS = 64


@functools.lru_cache(maxsize=2)
def _crc_shifts(n: int) -> np.ndarray:
    """Row t holds four tables, one a byte, that move a CRC-32 over 4*t zero bytes."""
    bit = np.arange(32, dtype=np.uint32)
    step = np.array([zlib.crc32(b"\0\0\0\0", 1 << int(b)) ^ zlib.crc32(b"\0\0\0\0", 0) for b in bit], np.uint32)
    units = np.empty((n + 1, 32), np.uint32)
    units[0] = np.uint32(1) << bit
    for t in range(1, n + 1):
        # one more word of zeros: apply `step` to every unit
        bits = (units[t - 1][:, None] >> bit) & np.uint32(1)
        units[t] = np.bitwise_xor.reduce(np.where(bits == 1, step[None, :], np.uint32(0)), axis=1)
    tables = np.zeros((n + 1, 4, 256), np.uint32)
    for b in range(8):  # a byte's entry is that of its lower bits and of its highest
        tables[:, :, 1 << b : 2 << b] = tables[:, :, : 1 << b] ^ units.reshape(n + 1, 4, 8)[:, :, b : b + 1]
    return tables


def _moved(crc: np.ndarray, tokens: np.ndarray | int, shifts: np.ndarray) -> np.ndarray:
    """CRCs after ``tokens`` more tokens of zeros."""
    low = np.uint32(255)
    return shifts[tokens, 0, crc & low] ^ shifts[tokens, 1, (crc >> np.uint32(8)) & low] ^ shifts[tokens, 2, (crc >> np.uint32(16)) & low] ^ shifts[tokens, 3, crc >> np.uint32(24)]


def _step_crcs(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every ``STEP`` ids of each document (the last ones may be fewer), and their number."""
    steps = -(-size // STEP)
    total = int(steps.sum())
    end = np.cumsum(steps)
    nth = np.arange(total) - np.repeat(end - steps, steps)
    start = np.repeat(first, steps) + nth * STEP
    n = np.minimum(np.repeat(size, steps) - nth * STEP, STEP)
    state = np.full(total, 0xFFFFFFFF, np.uint32)
    word = _crc_shifts(1)
    padded = np.append(ids, np.zeros(STEP, np.uint32))
    for j in range(STEP):
        after = _moved(state ^ padded[start + j], 1, word)
        state = np.where(j < n, after, state)
    return state ^ np.uint32(0xFFFFFFFF), steps


def _piece_crcs(crcs: np.ndarray, at: np.ndarray, tokens: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """CRC of each piece from those of its steps: crc(AB) = moved(crc(A), |B|) ^ crc(B)."""
    steps = -(-length // STEP)
    end = np.cumsum(steps)
    nth = np.arange(int(steps.sum())) - np.repeat(end - steps, steps)
    mine = crcs[np.repeat(at[doc] + start // STEP, steps) + nth]
    after = np.repeat(length, steps) - np.minimum((nth + 1) * STEP, np.repeat(length, steps))
    return np.bitwise_xor.reduceat(_moved(mine, after, shifts), end - steps)


#: Small letters below U+0100: runs of them are units that no normal form or lower case changes.
_UNIT = "[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+"
#: Signs that may follow a unit and are one piece to the vocabulary; an apostrophe or a ``<`` may begin other pieces.
_SIGNS = r"""[!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]+"""


class _Tokens:
    """Token ids of texts, remembered by part (what lies between ASCII white space).

    The vocabulary never joins across white space, so parts are independent. It lower-
    cases and separates letters from other signs, so a part of letters is one unit, and
    one that ends in a run of signs is that unit and the run. New units are encoded many
    at a time, by the merges alone, and told apart by the vocabulary's word ends; runs of
    signs are few; all other parts go one by one through the whole model. Ids of known parts lie in a flat
    array, from which texts are gathered; a part's word is the hash of its ids without the signs.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.merges = Merges.of(self.model.to_str())
        self.units = Tokenizer(self.model.model)
        self.units.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts = pa.array([], pa.string())
        self.flat, self.at, self.hash, self.seen = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the parts that several chunks held, if these are the lesser half."""
        keep = np.flatnonzero(self.seen > 2)
        if 2 * len(keep) > _WORDS:
            keep = keep[:0]
        size = self.at[keep + 1] - self.at[keep]
        self.flat = self.flat[_spans(self.at[keep], size)]
        self.parts, self.at, self.hash, self.seen = self.parts.take(pa.array(keep)), np.append(0, np.cumsum(size)), self.hash[keep], np.zeros(len(keep), np.int32)

    def _learn(self, new: pa.Array) -> None:
        found = pc.extract_regex(new, f"^(?P<unit>{_UNIT})(?P<sign>{_SIGNS})?$")
        plain = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        other = np.setdiff1d(np.arange(len(new)), plain, assume_unique=True)
        found = found.take(pa.array(plain))
        unit, sign = (found.field(name).dictionary_encode() for name in ("unit", "sign"))
        whole = new.take(pa.array(other)).to_pylist()
        more = [e.ids for e in self.model.encode_batch_fast([*sign.dictionary.to_pylist(), *whole], add_special_tokens=False)] if len(new) else []
        ids, size = self._encoded(unit.dictionary)
        size = np.concatenate([size, np.fromiter(map(len, more), np.int64, len(more))])
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(more), np.uint32, int(size.sum()) - len(ids))])
        at = np.append(np.cumsum(size) - size, len(ids))
        size = np.append(size, 0)
        # a part is two spans of ids: a unit and its signs, or all of it and nothing
        spans = np.full((len(new), 2), len(at) - 1)
        spans[plain, 0], spans[plain, 1] = unit.indices.to_numpy(), len(unit.dictionary) + sign.indices.to_numpy()
        spans[other, 0] = len(unit.dictionary) + len(sign.dictionary) + np.arange(len(other))
        first, sizes = at[spans], size[spans]
        words = _hashed(ids[_spans(first[:, 0], sizes[:, 0])], np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes[:, 0])
        self.flat = np.concatenate([self.flat, ids[_spans(first.ravel(), sizes.ravel())]])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes.sum(axis=1))])
        self.hash = np.concatenate([self.hash, words])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int32)])
        self.parts = pa.concat_arrays([self.parts, new])

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and their number."""
        # a matrix has the height of its longest word, so a very long one goes to the library
        if self.merges is not None and len(units) and pc.max(pc.binary_length(units)).as_py() <= 200:
            return self.merges.encode(units)
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        some = units.to_numpy(zero_copy_only=False).tolist()
        for at in range(0, len(some), 1000):
            few = some[at : at + 1000]
            found = np.array(self.units.encode_batch_fast([" ".join(few)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(few):  # a unit is not one unit to the vocabulary after all
                each = [e.ids for e in self.model.encode_batch_fast(few, add_special_tokens=False)]
                found, cuts = np.array(list(chain.from_iterable(each)), np.uint32), np.cumsum([len(e) for e in each])
            ids.append(found)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids with the end ids, ids per text, word hashes of all words, words per text."""
        if len(self.parts) > _WORDS:
            self._forget()
        parts = pc.ascii_split_whitespace(texts)
        first = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        # below U+0100 lower case is one letter for one in every rule
        plain = pc.match_substring_regex(coded.dictionary, r"^[\x{0}-\x{ff}]*$")
        known = pc.if_else(plain, pc.utf8_lower(coded.dictionary), coded.dictionary).dictionary_encode()
        code = pc.index_in(known.dictionary, self.parts)
        new = known.dictionary.filter(pc.is_null(code))
        if len(new):
            code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            code[code < 0] = len(self.parts) + np.arange(len(new))
            self._learn(new)
        else:
            code = code.to_numpy(zero_copy_only=False).astype(np.int64)
        self.seen[code] += 1
        mine = code[known.indices.to_numpy()][coded.indices.to_numpy()] if len(code) else np.zeros(0, np.int64)
        size = self.at[mine + 1] - self.at[mine]
        before = np.append(0, np.cumsum(size))[first]
        ids = np.insert(self.flat[_spans(self.at[mine], size)], before[1:], END).astype(np.uint32)
        named = size > 0  # an empty part is at either end of a text
        words = np.append(0, np.cumsum(named))[first]
        return ids, np.diff(before) + 1, self.hash[mine[named]], np.diff(words)


def _hashed(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """32 bits of a hash of each run of ids."""
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        nth = np.arange(len(ids), dtype=np.uint64) - np.repeat(first, size).astype(np.uint64)
        x = (ids.astype(np.uint64) + np.uint64(1)) * (nth * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[some] = np.add.reduceat(x ^ (x >> np.uint64(32)), first[some])
        out *= np.uint64(0x94D049BB133111EB)
    return (out >> np.uint64(32)).astype(np.uint32)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start+1, .. of every span."""
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> _Tokens:
    """One per worker process: a model is slow to load and what it learns is worth keeping."""
    return _Tokens(path)


def _counted(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text, their counts, and how many of them a text has."""
    keys = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(32), n) | words)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys.astype(np.uint32), counts, np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(n))


def _two_least(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lexical sketch of each text: the two least scrambled hashes of its distinct words, padded by 2^32."""
    pad = np.int64(1 << 32)
    out = np.full((2, len(n)), pad)
    some = np.flatnonzero(n)
    if len(some):
        x = _scrambled(words).astype(np.int64)
        first = (np.cumsum(n) - n)[some]
        out[0, some] = np.minimum.reduceat(x, first)
        x[x == np.repeat(out[0], n)] = pad
        out[1, some] = np.minimum.reduceat(x, first)
    return out[0], out[1]


def _binary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """One binary value of ``n`` numbers a row."""
    at = np.append(0, np.cumsum(n) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _chunks(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes of a column, one row at least."""
    nbytes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(nbytes) - nbytes) // size
    at = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), batch.num_rows).tolist() if batch.num_rows else []
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield batch.slice(a, b - a)


_TOKENISED = "id bigint, tokens bigint, crcs binary, words binary, counts binary, sketch bigint, sketch2 bigint, spread bigint, n_words bigint"


def _tokenised(path: str):
    names = ["id", "tokens", "crcs", "words", "counts", "sketch", "sketch2", "spread", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokens(path)
        row = np.int64(TaskContext.get().partitionId()) << 40
        for batch in batches:
            for part in _chunks(batch, 1, _CHUNK):
                ids, size, words, n_words = model.of(pc.fill_null(part.column(1), ""))
                crcs, steps = _step_crcs(ids, np.cumsum(size) - size, size)
                words, counts, n = _counted(words, n_words)
                sketch, sketch2 = _two_least(words, n)
                spread = row + np.arange(part.num_rows)
                row += part.num_rows
                # counts over 255 need the wider form; a row's length tells which it is
                narrow = not len(counts) or counts.max() < 256
                arrays = [pa.array(size), _binary(crcs, steps), _binary(words, n), _binary(counts.astype(np.uint8 if narrow else np.uint32), n)]
                arrays += [pa.array(x.astype(np.int64)) for x in (sketch, sketch2, spread, n_words)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, *part.columns[2:]], [*names, *batch.schema.names[2:]])

    return run


def _scrambled(words: np.ndarray) -> np.ndarray:
    x = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(32)


#: Keys of the number of documents and of their words among the document frequencies.
_DOCS, _LENGTH = -1, -2


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, word, n): documents of a packing task that hold a word."""
    keys, n, docs, length, task, held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0, 0, None, [], 0

    def merged():
        found, more = np.unique(np.concatenate(held), return_counts=True)
        both, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([n, more]), len(both)).astype(np.int64)

    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0)[0].as_py()
        docs += batch.num_rows
        length += pc.sum(batch.column(2)).as_py()
        held.append(_numbers(batch.column(1)))
        size += len(held[-1])
        if size > 2_000_000:
            keys, n = merged()
            held, size = [], 0
    if task is not None:
        if held:
            keys, n = merged()
        keys, n = np.append(keys.astype(np.int64), [_DOCS, _LENGTH]), np.append(n, [docs, length])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), task, np.int32)), pa.array(keys), pa.array(n)], ["task", "word", "n"])


def _numbers(column: pa.Array) -> np.ndarray:
    """All 32-bit numbers of a binary column."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u4") if at[-1] > at[0] else np.zeros(0, np.uint32)


def corpus_statistics(ready: DataFrame, tasks: int) -> DataFrame:
    """``(task, word, df)``: for every task, the corpus-wide frequency of each word that several of its documents hold.

    A word of one document only finds no neighbour for it.
    """
    words = checkpointed(ready.select("task", "words", "n_words").repartitionById(tasks, "task").mapInArrow(_frequencies, "task int, word bigint, n bigint"))
    total = words.groupBy("word").agg(F.sum("n").alias("df"))
    return join_on_hidden_key(words.where("n > 1 or word < 0").select("task", "word"), total, "word", "inner").select("task", "word", "df")


class _Corpus:
    """Number, mean length and document frequencies of all documents; a word not listed is in one."""

    def __init__(self, words: np.ndarray, df: np.ndarray, docs: int, mean: float):
        self.words, self.df, self.docs, self.mean = words, df, docs, mean

    @classmethod
    def listed(cls, words: np.ndarray, df: np.ndarray) -> _Corpus:
        """From the rows of ``corpus_statistics`` for one task."""
        order = np.argsort(words)
        words, df = words[order], df[order]
        at = int(np.searchsorted(words, 0))
        whole = dict(zip(words[:at].tolist(), df[:at].tolist(), strict=True))
        return cls(words[at:].astype(np.uint32), df[at:].astype(np.uint32), whole[_DOCS], whole[_LENGTH] / max(1, whole[_DOCS]))

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(terms), np.int64)
        at = np.minimum(np.searchsorted(self.words, terms), len(self.words) - 1)
        return np.where(self.words[at] == terms, self.df[at], 1).astype(np.int64)


class _Shard:
    """A BM25 inverted index over the word counts of some documents, weighted as in the whole corpus (or by itself)."""

    def __init__(self, words: list[np.ndarray], counts: list[np.ndarray], corpus: _Corpus | None = None):
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        terms, codes = np.unique(np.concatenate(words) if n else np.zeros(0, np.uint32), return_inverse=True)
        docs = np.repeat(np.arange(n, dtype=np.int32), size)
        tf = np.concatenate(counts).astype(np.float32) if n else np.zeros(0, np.float32)
        length = np.bincount(docs, tf, n)
        here = np.bincount(codes, minlength=len(terms))
        if corpus is None:
            corpus = _Corpus(terms, here, n, length.mean() if n else 1.0)
        df = corpus.frequencies(terms)
        idf = np.log1p((corpus.docs - df + 0.5) / (df + 0.5))
        short = (K1 * (1 - B + B * length / max(1.0, corpus.mean))).astype(np.float32)
        weight = idf.astype(np.float32)[codes] * tf * np.float32(K1 + 1) / (tf + short[docs])
        # a word that no other document here holds finds nobody
        common = here * _COMMON >= max(n, 2 * _COMMON)
        rank = np.cumsum(common) - 1
        mine = common[codes]
        self.matrix = np.zeros((n, int(common.sum())), np.float32)
        self.matrix[docs[mine], rank[codes[mine]]] = weight[mine]
        listed = (here > 1) & ~common
        rank = np.cumsum(listed) - 1
        mine = np.flatnonzero(listed[codes])
        codes, docs, weight = rank[codes[mine]], docs[mine], weight[mine]
        order = np.argsort(codes, kind="stable")
        self.docs, self.weight = docs[order], weight[order]
        self.at = np.append(0, np.cumsum(np.bincount(codes, minlength=int(listed.sum()))))
        self.query, self.query_at = codes, np.append(0, np.cumsum(np.bincount(docs, minlength=n)))
        self.n = n
        self.seeds, self.products = np.zeros(0, np.int64), None

    def scores(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """BM25 of every document for all words of ``doc``."""
        at = np.searchsorted(self.seeds, doc)
        if at == len(self.seeds) or self.seeds[at] != doc:
            # the next documents that may become seeds are scored along with it
            later = doc + 1 + np.flatnonzero(unused[doc + 1 :])[: _SEEDS - 1]
            self.seeds, at = np.append(doc, later), 0
            self.products = (self.matrix[self.seeds] > 0).astype(np.float32) @ self.matrix.T
        out = self.products[at]
        query = self.query[self.query_at[doc] : self.query_at[doc + 1]]
        if len(query):
            spans = _spans(self.at[query], self.at[query + 1] - self.at[query])
            out = out + np.bincount(self.docs[spans], self.weight[spans], self.n)
        return out

    def neighbours(self, doc: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share words with ``doc``, best first, ties in order."""
        scores = self.scores(doc, unused)
        hit = np.flatnonzero((scores > 0) & unused)
        score = -scores[hit]
        if len(hit) > 4 * _SEEDS:
            # few are taken, so sort only the best at first
            bound = np.partition(score, _SEEDS)[_SEEDS]
            best = np.flatnonzero(score <= bound)
            yield from hit[best[np.argsort(score[best], kind="stable")]].tolist()
            left = score > bound
            hit, score = hit[left], score[left]
        yield from hit[np.argsort(score, kind="stable")].tolist()


class _Packer:
    """Windows of one task; ``pieces`` are (doc, start, length, sequence, offset)."""

    def __init__(self, length: int):
        self.length, self.pieces = length, []
        self.sequences, self.open, self.fill = 0, None, 0

    def _new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def pack(self, tokens: np.ndarray, shard: _Shard) -> None:
        """Pack a shard's documents; a window that is not full stays open for the next."""
        start = tokens // self.length * self.length
        for doc in np.flatnonzero(start).tolist():
            self.pieces += [(doc, a, self.length, self._new(), 0) for a in range(0, int(start[doc]), self.length)]
        rest = tokens - start
        unused = rest > 0
        for seed in range(shard.n):
            while unused[seed]:
                for doc in self._fillers(seed, shard, unused):
                    self._take(doc, start, rest, unused)
                    if self.open is None:
                        break

    def _fillers(self, seed: int, shard: _Shard, unused: np.ndarray) -> Iterator[int]:
        yield seed
        for found in (shard.neighbours(seed, unused), (seed + np.flatnonzero(unused[seed:])).tolist()):
            for doc in found:
                if unused[doc]:
                    yield doc

    def _take(self, doc: int, start: np.ndarray, rest: np.ndarray, unused: np.ndarray) -> None:
        if self.open is None:
            self.open, self.fill = self._new(), 0
        n, room = int(rest[doc]), self.length - self.fill
        if n > room:
            n = room // STEP * STEP
        self.pieces.append((doc, int(start[doc]), n, self.open, self.fill))
        start[doc] += n
        rest[doc] -= n
        unused[doc] = rest[doc] > 0
        self.fill += n
        if self.fill > self.length - STEP:
            self.open = None


def _packed(length: int, range_slots: int | None = None):
    """A task's statistics (rows with a word) come before its documents; with ``range_slots``, these have slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = _crc_shifts(length)
        task = np.int64(TaskContext.get().partitionId()) << 40
        packer = _Packer(length)
        held, postings, now = [], 0, None
        listed, corpus = [], None

        def shard_out() -> pa.RecordBatch:
            tokens = np.array([r[1] for r in held], np.int64)
            words = [np.frombuffer(r[3], "<u4") for r in held]
            counts = [np.frombuffer(r[4], np.uint8 if len(r[4]) == len(w) else "<u4") for r, w in zip(held, words, strict=True)]
            packer.pieces = []
            packer.pack(tokens, _Shard(words, counts, corpus))
            doc, start, n, sequence, offset = (np.array(c, np.int64) for c in zip(*packer.pieces, strict=True))
            crcs = [np.frombuffer(r[2], "<u4") for r in held]
            at = np.append(0, np.cumsum([len(c) for c in crcs]))
            crc = _piece_crcs(np.concatenate(crcs), at, tokens, doc, start, n, shifts)
            ids = pa.array([held[d][0] for d in doc.tolist()], pa.int64())
            return pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(n), pa.array(crc.astype(np.int64)), pa.array(tokens[doc]), pa.array(task + sequence), pa.array(offset)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column("word")))
            if known.num_rows:
                listed.append((known.column("word").to_numpy(), known.column("df").to_numpy()))
                batch = batch.filter(pc.is_null(batch.column("word")))
            if not batch.num_rows:
                continue
            if corpus is None:
                corpus = _Corpus.listed(*(np.concatenate(c) for c in zip(*listed, strict=True)))
                listed = []
            slots = batch.column("slot").to_pylist() if range_slots else [0] * batch.num_rows
            for *row, slot in zip(*(batch.column(c).to_pylist() for c in ("id", "tokens", "crcs", "words", "counts")), slots, strict=True):
                if range_slots and slot // range_slots != now:
                    if held:
                        yield shard_out()
                        held, postings = [], 0
                    now = slot // range_slots
                    packer, task = _Packer(length), np.int64(now) << 40
                held.append(row)
                postings += len(row[3]) // 4
                if len(held) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield shard_out()
                    held, postings = [], 0
        if held:
            yield shard_out()

    return run


def _with_salt(ready: DataFrame) -> DataFrame:
    """``salt`` deals the rows of a sketch that more than ``HOT_ROWS`` share over places of about so many."""
    sketch = F.struct("sketch", "sketch2")
    hot = ready.groupBy(sketch.alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    hot = checkpointed(hot)
    few = hot.limit(HOT_BROADCAST + 1).count() <= HOT_BROADCAST
    marked = ready.withColumn("_hot", sketch)
    marked = marked.join(F.broadcast(hot), "_hot", "left") if few else join_on_hidden_key(marked, hot, "_hot")
    places = F.ceil(F.col("_n") / HOT_ROWS)
    return marked.withColumn("salt", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("spread"), places))).drop("_hot", "_n")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, slot_cols: tuple[str, str] | None = None) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` per piece.

    A document is its text's token ids (null text: none) and one end id. Every id
    lies in exactly one piece; a piece never leaves its sequence of ``length`` ids
    and offsets are gapless. ``start`` of a cut is a multiple of 16, so a full
    window lacks at most 15 ids. ``tokenizer`` is a path that every executor can
    read (default: the installed public vocabulary). ``slot_cols`` name the slot of a mix
    and the place in it: sequences then follow the mix, as ``RANGE_SLOTS`` slots are packed
    by themselves and ``sequence_id`` ascends with the slots. Repeated rows and null ids are
    packed row by row. An empty table gives an empty result. Texts are packed whole, however
    long; other columns are not read, whatever their names.
    """
    if length % STEP:
        raise ValueError(f"length must be a multiple of {STEP}")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    slots = dict(zip(("slot", "place"), slot_cols, strict=True)) if slot_cols else {}
    rows = only(df, id=id_col, text=text_col, **slots)
    schema = _TOKENISED + "".join(f", {c} bigint" for c in slots)
    ready = checkpointed(rows.mapInArrow(_tokenised(tokenizer), schema))
    if slots:
        tasks = (ready.agg(F.max("slot")).first()[0] or 0) // (RANGE_SLOTS * TASK_RANGES) + 1
        task, order = F.floor(F.col("slot") / (RANGE_SLOTS * TASK_RANGES)), ("slot", "place", "id")
    else:
        docs, size = ready.agg(F.count("*"), F.sum(F.octet_length("crcs") + F.octet_length("words") + F.octet_length("counts"))).first()
        tasks = max(1, -(-docs // TASK_DOCS), -(-(size or 0) // TASK_BYTES))
        ready = _with_salt(ready)
        task, order = F.pmod(F.xxhash64("sketch", "sketch2", "salt"), F.lit(tasks)), ("sketch", "sketch2", "salt", "id")
    ready = ready.withColumn("task", task.cast("int"))
    dealt = ready.unionByName(corpus_statistics(ready, tasks), allowMissingColumns=True).repartitionById(tasks, "task")
    dealt = dealt.sortWithinPartitions(F.col("word").isNull(), *order)
    return dealt.mapInArrow(_packed(length, RANGE_SLOTS if slots else None), "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
