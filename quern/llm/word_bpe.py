"""Byte-pair merges of many words at once.

The tokenizers library merges word by word. A corpus brings words by the million that
occur once, and their merges are most of the cost of tokenising it. Here the symbols of
thousands of words lie in one matrix, a column a word, and every round merges the pair
of least rank of every word. Ids are those of the library, which tests compare.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

_U = np.uint64
_NONE, _EMPTY = np.uint32(2**32 - 1), _U(2**64 - 1)
_BITS = 19
#: Words in one matrix, and how far their lengths may differ.
_ROWS, _SPREAD = 5000, 3


def _byte_names() -> list[str]:
    """The letter by which a byte-level vocabulary names each byte: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in prints}
    for nth, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + nth)
    return [names[b] for b in range(256)]


class Merges:
    """The merges of a byte-level vocabulary that marks word ends."""

    def __init__(self, spec: dict):
        vocabulary, suffix = spec["vocab"], spec["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], _U) for i in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.uint32)
        self.begin = np.array([vocabulary[c] for c in _byte_names()], np.uint32)
        self.end = np.array([vocabulary[c + suffix] for c in _byte_names()], np.uint32)
        # ranks by pair in a table with open addressing; it never fills a tenth
        self.key, self.rank = np.full((1 << _BITS) + 64, _EMPTY), np.full((1 << _BITS) + 64, _NONE)
        key = (left << _U(32)) | right
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.key[at] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            placed = free & first
            self.key[at[placed]], self.rank[at[placed]] = key[todo[placed]], todo[placed]
            todo, at = todo[~placed], at[~placed] + 1

    @classmethod
    def of(cls, model: str) -> Merges | None:
        """From a tokenizer's JSON; None where its merges follow other rules."""
        spec = json.loads(model)["model"]
        usual = spec.get("type") == "BPE" and spec.get("end_of_word_suffix") and not any(spec.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        known = usual and all(c in spec["vocab"] and c + spec["end_of_word_suffix"] in spec["vocab"] for c in _byte_names())
        return cls(spec) if known and len(spec["merges"]) < (1 << _BITS) // 8 else None

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        x = key * _U(0x9E3779B97F4A7C15)
        return (((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)) >> _U(64 - _BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; the greatest number where it does not merge."""
        key = (left.astype(_U) << _U(32)) | right
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.rank[at], _NONE)
        more = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(more):
            at[more] += 1
            found = self.key[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.rank[at[more[hit]]]
            more = more[~hit & (found != _EMPTY)]
        return out

    def _matrix(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge a matrix of symbols (one row more than the longest word): ids and their number."""
        height, n = symbols.shape
        nth = np.arange(height)[:, None]
        rank = np.full((height, n), _NONE)
        pairs = np.where(nth[:-1] + 1 < size, self.ranks(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(height - 1, n), _NONE)
        rank[:-1] = pairs
        ids, sizes, which, size = np.zeros_like(symbols), np.zeros(n, np.int64), np.arange(n), size.copy()
        while len(which):
            at, column = rank.argmin(axis=0), np.arange(len(which))
            best = rank[at, column]
            done = best == _NONE
            if done.any():
                ids[:, which[done]], sizes[which[done]] = symbols[:, done], size[done]
                go = np.flatnonzero(~done)
                symbols, rank, size, which, at, best = symbols[:, go], rank[:, go], size[go], which[go], at[go], best[go]
                column = np.arange(len(go))
                if not len(go):
                    break
            symbols[at, column] = self.merged[best]
            # what lies behind the pair moves up by one
            behind = nth > at
            symbols[:-1] = np.where(behind[:-1], symbols[1:], symbols[:-1])
            rank[:-1] = np.where(behind[:-1], rank[1:], rank[:-1])
            size -= 1
            rank[at, column] = np.where(at + 1 < size, self.ranks(symbols[at, column], symbols[np.minimum(at + 1, height - 1), column]), _NONE)
            inner = np.flatnonzero(at > 0)
            rank[at[inner] - 1, inner] = self.ranks(symbols[at[inner] - 1, inner], symbols[at[inner], inner])
        return ids, sizes

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their number for each; no word is empty."""
        n = len(words)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        first = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        size = np.diff(first)
        order = np.argsort(size, kind="stable")
        ordered, parts, sizes, begin = size[order], [], np.zeros(n, np.int64), 0
        while begin < n:
            stop = min(begin + _ROWS, int(np.searchsorted(ordered, ordered[begin] + _SPREAD, side="right")))
            rows, length = order[begin:stop], ordered[begin:stop]
            nth = np.arange(int(length[-1]) + 1)[:, None]
            symbols = self.begin[data[np.where(nth < length, first[rows] + nth, 0)]]
            symbols[length - 1, np.arange(len(rows))] = self.end[data[first[rows] + length - 1]]
            ids, found = self._matrix(symbols, length)
            parts.append((rows, ids, found))
            sizes[rows] = found
            begin = stop
        out, at = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        for rows, ids, found in parts:
            nth = np.arange(len(ids))[:, None]
            inside = nth < found
            out[(at[rows] + nth)[inside]] = ids[inside]
        return out, sizes
