"""Toxicity by weak supervision.

1. Lexicons are mined on a bounded sample of labelled rows: words and word beginnings
   that occur in toxic texts far more often than chance allows. Near copies of one
   text count once, or every word of a copied text would look like evidence.
2. Each lexicon entry is a voter (toxic where it occurs, else it abstains); pattern
   voters look at how many entries occur, how densely, or that none does.
3. A generative label model estimates every voter's rates in both classes by EM, and
   the voters' correlations from what is left after their class means; a voter counts
   less the more of it others repeat. It gives each sampled text a posterior label.
4. A linear classifier is trained on the posteriors; it scores every whole text.

Gold labels serve step 1 and the prior of step 3. Fitting sees at most ``FIT_ROWS``
labelled rows (those of least id hash); scoring sees all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, only, table
from quern.llm.simhash import fingerprint

FIT_ROWS = 20_000
#: Most lexicon entries kept; candidates are ranked by evidence.
ENTRIES = 400
REJECT = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = range(3, 9)
_CACHE = 300_000


def _entries(word: str) -> list[str]:
    """The word itself (closed by $) and its beginnings."""
    return [word + "$", *(word[:k] for k in _PREFIXES if k <= len(word))]


class Lexicon(dict):
    """Word to the numbers of the entries that it matches, remembered."""

    def __init__(self, entries: list[str]):
        super().__init__()
        self.number = {e: i for i, e in enumerate(entries)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _CACHE:
            self.clear()
        self[word] = found = tuple(self.number[e] for e in _entries(word) if e in self.number)
        return found

    def hits(self, text: str | None) -> tuple[dict[int, int], int]:
        """Occurrences of each entry, and the number of words."""
        words = Counter(_WORD.findall((text or "").lower()))
        out: dict[int, int] = {}
        for word, n in words.items():
            for e in self[word]:
                out[e] = out.get(e, 0) + n
        return out, words.total()


def _features(hits: list[tuple[dict[int, int], int]], n: int) -> np.ndarray:
    """One row a text: log occurrences of each entry, then totals and density."""
    x = np.zeros((len(hits), n + 3))
    for i, (found, words) in enumerate(hits):
        for e, k in found.items():
            x[i, e] = np.log1p(k)
        total = sum(found.values())
        x[i, n:] = np.log1p(len(found)), np.log1p(total), min(1.0, 10 * total / max(words, 1))
    return x


def votes(hits: list[tuple[dict[int, int], int]], n: int) -> np.ndarray:
    """1 toxic, -1 clean, 0 abstain: one voter an entry, then four patterns."""
    out = np.zeros((len(hits), n + 4), np.int8)
    for i, (found, words) in enumerate(hits):
        for e in found:
            out[i, e] = 1
        total = sum(found.values())
        out[i, n] = 1 if len(found) >= 2 else 0
        out[i, n + 1] = 1 if total >= 3 else 0
        out[i, n + 2] = 1 if total and 200 * total >= words else 0
        out[i, n + 3] = 0 if total else -1
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior of the toxic class from votes alone, by EM with correlated voters."""
    fired = np.stack([v == 1, v == -1], axis=2).astype(float)  # text, voter, kind of vote
    # begin with the texts of most votes, as many as the prior says
    total = v.sum(axis=1)
    q = np.where(total > min(np.quantile(total, 1 - prior), total.max() - 1), 0.9, 0.1)
    weight = np.ones(v.shape[1])
    for _ in range(rounds):
        rates = []
        for side in (q, 1 - q):
            yes = np.tensordot(side, fired, axes=1)
            rates.append((yes + 0.1) / (side.sum() + 0.3))
        # what voters share beyond their class means
        centred = (v != 0) - np.outer(q, rates[0].sum(axis=1)) - np.outer(1 - q, rates[1].sum(axis=1))
        spread = np.sqrt((centred**2).mean(axis=0)) + 1e-6
        alike = np.abs(centred.T @ centred / len(v) / np.outer(spread, spread))
        np.fill_diagonal(alike, 0)
        weight = 1 / (1 + np.where(alike > 0.2, alike, 0).sum(axis=1))
        logs = [np.log(r) for r in rates]
        silent = [np.log(np.clip(1 - r.sum(axis=1), 1e-6, 1)) for r in rates]
        odds = np.log(prior / (1 - prior)) + (fired * weight[None, :, None]).reshape(len(v), -1) @ (logs[0] - logs[1]).reshape(-1)
        odds += (v == 0) @ (weight * (silent[0] - silent[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-4:
            break
    return q


def _logistic(x: np.ndarray, q: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the constant last) of a logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (q - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Lexicon entries and the weights of the linear classifier."""

    def __init__(self, entries: list[str], weights: np.ndarray):
        self.entries, self.weights = entries, weights

    def scores(self, texts, lexicon: Lexicon) -> np.ndarray:
        out = []
        for at in range(0, len(texts), 1000):
            x = _features([lexicon.hits(t) for t in texts[at : at + 1000]], len(self.entries))
            out.append(x @ self.weights[:-1] + self.weights[-1])
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: Column) -> Column:
        """Score column: 0 to 1, higher is more likely toxic; null and empty texts too."""
        model = self

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            lexicon = Lexicon(model.entries)
            for texts in parts:
                yield pd.Series(model.scores(texts.tolist(), lexicon))

        return run(text)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each entry, by label; one partial sum a task."""
    sums: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found: set[str] = set()
            for word in set(_WORD.findall((text or "").lower())):
                found.update(_entries(word))
            for e in found:
                sums.setdefault(e, [0, 0])[toxic] += 1
            if len(sums) > 1_000_000:
                yield _sums_frame(sums)
                sums = {}
    yield _sums_frame(sums)


def _sums_frame(sums: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], ["entry", "clean", "toxic"])


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["row", "fp"])


def _apart(fps: np.ndarray, radius: int = 8) -> np.ndarray:
    """Which fingerprints are not within the radius of an earlier one."""
    keep = np.ones(len(fps), bool)
    for i in range(len(fps)):
        if keep[i]:
            keep[i + 1 :] &= np.bitwise_count(fps[i + 1 :] ^ fps[i]) > radius
    return keep


def _hits(lexicon_entries: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(lexicon_entries)
        for batch in batches:
            found = [lexicon.hits(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(h) for h, _ in found], pa.list_(pa.int32())), pa.array([list(h.values()) for h, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64())], ["entries", "n", "words"])

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows; nothing but text and label enters it.

    Rows with a null label or text are left out; rows repeated with an id count once. Without
    toxic and clean rows, as in an empty table, the model is constant: the smoothed share of
    toxic rows. Texts are read whole; other columns are not read, whatever their names.
    """
    rows = only(labelled, id=id_col, text=text_col, toxic=label_col).where("toxic is not null and text is not null")
    rows = rows.select(F.xxhash64("id", F.lit(11)).alias("row"), "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    # the cut is found on hashes alone, so that no task gathers the texts; an id counts once
    cut = rows.select("row").distinct().orderBy("row").limit(FIT_ROWS).agg(F.max("row").alias("cut")).first().cut
    few = rows.where(F.col("row") <= F.lit(cut if cut is not None else 0)).groupBy("row").agg(F.min(F.struct("text", "toxic")).alias("one"))
    sample = checkpointed(few.select("row", "one.text", "one.toxic"))
    prints = sample.select("row", "text").mapInArrow(_fingerprinted, "row bigint, fp bigint").orderBy("row", "fp").toPandas()
    fps = prints["fp"].to_numpy().view(np.uint64) if len(prints) else np.zeros(0, np.uint64)
    alone = prints[_apart(fps)]["row"].astype("int64").tolist()
    # at most FIT_ROWS numbers
    chosen = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(x,) for x in alone] or [], "row bigint")), "row", "left_semi")
    sizes = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    prior = (toxic + 0.5) / (clean + toxic + 1.0)
    constant = Model([], np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))]))
    if not clean or not toxic:
        return constant
    sums = chosen.select("text", "toxic").mapInArrow(_counts, "entry string, clean bigint, toxic bigint").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3")
    sums = checkpointed(sums)
    # evidence: twice the log likelihood ratio against the base rate
    a, b = F.col("toxic"), F.col("clean")
    side = lambda k, n, rate: F.when(k > 0, k * F.log(k / (n * F.lit(rate)))).otherwise(0.0)
    evidence = 2 * (side(a, a + b, toxic / (clean + toxic)) + side(b, a + b, clean / (clean + toxic)))
    tried = max(sums.count(), 1)
    strong = sums.withColumn("g", evidence).where((F.col("g") > 2 * np.log(tried) + 2) & (a / toxic >= 8 * b / clean))
    ranked = strong.orderBy(F.desc("g"), F.length("entry"), "entry").limit(10 * ENTRIES).collect()
    entries: list[str] = []
    for r in ranked:
        if len(entries) < ENTRIES and not any(r.entry.startswith(e) or e.startswith(r.entry.rstrip("$")) for e in entries):
            entries.append(r.entry)
    if not entries:
        return constant
    found = chosen.orderBy("row").select("text").mapInArrow(_hits(entries), "entries array<int>, n array<int>, words bigint").toPandas()
    hits = [(dict(zip(map(int, e), map(int, k), strict=True)), int(w)) for e, k, w in zip(found["entries"], found["n"], found["words"], strict=True)]
    posterior = label_model(votes(hits, len(entries)), prior)
    return Model(entries, _logistic(_features(hits, len(entries)), posterior))


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` for each row; ``predicted`` is 1 where score >= 0.7.

    Every row is scored by its own whole text, so repeated rows and null ids get scores like
    any other; a null or empty text scores as one without any word. An empty table gives an
    empty result; other columns are not read, whatever their names.
    """
    out = only(df, id=id_col, text=text_col).select("id", model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_on_tables(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents that are not held out."""
    marks = labels.select(F.col("doc_id").alias("_label_id"), F.col("toxic").alias("_label_toxic")).where(~held_out(F.col("_label_id")) & F.col("_label_toxic").isNotNull())
    # the least id hashes, so that no more than FIT_ROWS labels ever join the texts
    marks = marks.groupBy("_label_id").agg(F.max("_label_toxic").alias("_label_toxic")).orderBy(F.xxhash64("_label_id", F.lit(11)), "_label_id").limit(FIT_ROWS)
    joined = only(docs, id="doc_id", text="text").join(F.broadcast(marks), F.col("id") == F.col("_label_id"))
    return fit(joined, "id", "text", "_label_toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit_on_tables(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted")
