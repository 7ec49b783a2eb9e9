"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A language's profile is its ``PROFILE`` most frequent character n-grams (n = 1..3,
words padded by a blank) in rank order, counted over all training texts. A text's
own most frequent n-grams are compared by out-of-place distance: the sum of how far
each stands from its place in the profile, or the maximum where it is absent.

All letters of the training texts are numbered in a first pass; letters outside them
share one number. An n-gram is then one integer, so counting is integer
arithmetic, and partial counts of a batch are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import only, table

PROFILE = 400
#: Bits of a letter's number, more where the alphabet is larger: 18 hold every letter of Unicode, 20 fit three times.
_BITS, _BLANK, _OTHER = 12, 0, 1
_LETTER = regex.compile(r"\p{L}")
_LETTERS_FOUND: dict[int, bool] = {}
_BLOCK = 1 << 20


def _is_letter(code: int) -> bool:
    found = _LETTERS_FOUND.get(code)
    if found is None:
        found = _LETTERS_FOUND[code] = 0xD800 > code and bool(_LETTER.match(chr(code))) or code > 0xDFFF and bool(_LETTER.match(chr(code)))
    return found


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; zero where there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (points >= 97) & (points <= 122)
    odd = points > 127
    if odd.any():
        distinct, at = np.unique(points[odd], return_inverse=True)
        letters[odd] = np.fromiter(map(_is_letter, distinct.tolist()), bool, len(distinct))[at]
    return np.where(letters, points, 0)


def _numbered(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Alphabet numbers, every run of other characters one blank, a blank at both ends."""
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    numbers = np.where(alphabet[at] == codes, at + 2, _OTHER)
    numbers[codes == 0] = _BLANK
    keep = np.ones(len(codes), bool)
    keep[1:] = (numbers[1:] != _BLANK) | (numbers[:-1] != _BLANK)
    return np.concatenate([[_BLANK], numbers[keep], [_BLANK]]).astype(np.int64)


def _grams(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram integers and their counts; an n-gram has a blank at its ends only, and is not all blank."""
    one, a, b, c = numbers, numbers[:-2], numbers[1:-1], numbers[2:]
    two = ((numbers[:-1] << bits) | numbers[1:])[(numbers[:-1] | numbers[1:]) > 0]
    three = ((a << 2 * bits) | (b << bits) | c)[b > 0]
    found = np.concatenate([one[one > 0], two | (1 << 3 * bits), three | (2 << 3 * bits)])
    return np.unique(found, return_counts=True)


def _blocks(text: str) -> Iterator[str]:
    """Pieces of a very long text, cut at a blank near every _BLOCK characters."""
    at = 0
    while at < len(text):
        end = at + _BLOCK
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def _counted(text: str, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = max(_BITS, (len(alphabet) + 1).bit_length())
    parts = [_grams(_numbered(c, alphabet), bits) for c in map(_codes, _blocks(text)) if c.any()]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else _summed(parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]).astype(np.float64)).astype(np.int64)


def _per_language(count, split: int = 500):
    """Batches of (lang, text) to partial sums (lang, key, n) of ``count(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        docs: dict[str, int] = {}

        def out(lang):
            keys, n = _summed(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                keys, n = count(text.as_py())
                parts = held.setdefault(lang, [])
                parts.append((keys.astype(np.int64), n.astype(np.int64)))
                docs[lang] = docs.get(lang, 0) + 1
                if len(parts) >= split:
                    held[lang] = [_summed(parts)]
                if len(held) > 200:  # many languages at once: pass on what there is
                    yield from [out(x) for x in list(held)]
        yield from [out(x) for x in list(held)]

    return run


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for block in _blocks(text):
        codes = _codes(block)
        parts.append(np.unique(codes[codes > 0], return_counts=True))
    return _summed(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _top(df: DataFrame, n: int) -> dict[str, list[int]]:
    """The n most frequent keys of each language, in rank order, ties by key.

    What reaches the driver has at most n rows for each language.
    """
    from pyspark.sql import Window

    counts = df.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    # two steps, so that no task ranks all keys of a language
    near = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(F.desc("n"), "key")
    ranked = counts.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= n)
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    ranked = ranked.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").select("lang", "key").toLocalIterator():
        out.setdefault(r.lang, []).append(r.key)
    return out


class Profiles:
    """Learned profiles: an alphabet and one ranked n-gram list per language."""

    def __init__(self, alphabet: np.ndarray, ranked: dict[str, list[int]], size: int = PROFILE):
        self.alphabet, self.size = alphabet, size
        self.langs = sorted(ranked)
        self.keys = [np.sort(np.array(ranked[g], np.int64)) for g in self.langs]
        self.ranks = [np.argsort(np.array(ranked[g], np.int64), kind="stable") for g in self.langs]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 / (1 + e^-x), x = 20 times the gap to the second-best distance.

        Distances are divided by their maximum; ties go to the smaller name.
        """
        keys, n = _counted(text, self.alphabet) if text else (np.zeros(0, np.int64),) * 2
        if not len(keys) or not self.langs:
            return "und", 0.0
        mine = keys[np.lexsort((keys, -n))][: self.size]
        place = np.arange(len(mine))
        distances = []
        for known, rank in zip(self.keys, self.ranks, strict=True):
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            distances.append(np.where(known[at] == mine, np.minimum(np.abs(rank[at] - place), self.size), self.size).sum() / (self.size * len(mine)))
        order = np.argsort(distances, kind="stable")
        if len(order) == 1:
            return self.langs[0], float(1 - distances[0])
        gap = distances[order[1]] - distances[order[0]]
        return self.langs[order[0]], float(1 / (1 + np.exp(-20 * gap)))


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> Profiles:
    """Profiles over all rows with a language and a text; counts cover whole texts.

    Repeated rows count each time. Without such rows, as in an empty table, there are no
    profiles and every text is ``und``. Other columns are not read, whatever their names.
    """
    rows = only(df, lang=lang_col, text=text_col).where("lang is not null and text is not null")
    schema = "lang string, key bigint, n bigint"
    # at most the letters of Unicode reach the driver
    letters = rows.mapInArrow(_per_language(_letters), schema).select("key").distinct().toArrow()
    alphabet = np.sort(letters["key"].to_numpy())
    if not len(alphabet):
        return Profiles(np.zeros(1, np.int64), {}, size)
    grams = rows.mapInArrow(_per_language(lambda text: _counted(text, alphabet)), schema)
    return Profiles(alphabet, _top(grams, size), size)


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for each row: ``und`` and 0 for a text that is null or has no letter.

    Repeated rows and null ids are judged like any other, long texts in pieces but whole. An
    empty table gives an empty result; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    rows = only(df, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out_of_sample = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    profiles = learn(docs.where(F.coalesce(~out_of_sample, F.lit(True))))
    out = predict(docs, profiles)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")
