import itertools
import os

import numpy as np
import pytest

from quern.llm import hilbert_ann


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_ann.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute(rows, every, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q in ok:
        if q % every == 0:
            found = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k]
            out[q] = found
    return out


def test_exact_when_blocks_cover_the_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(7, rows[7][1])]
    rows += [(400, None), (410, [0.0] * 8), (420, [1.0] * 7 + [float("nan")]), (430, [1.0] * 7 + [None]), (440, []), (None, [1.0] * 8), (450, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as id", "2 as q", "3 as rank")
    got = {}
    for r in hilbert_ann.nearest(df, every=10, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(rows, 10, 5)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [i for _, _, i in sorted(found)] == [i for _, i in want[q]]
        assert [s for _, s, _ in sorted(found)] == pytest.approx([s for s, _ in want[q]])
        assert [n for n, _, _ in sorted(found)] == [1, 2, 3, 4, 5]


def clustered(n=3000):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 2
    return [(i, [float(x) for x in centres[i % 30] + rng.normal(size=8) * 0.5]) for i in range(n)]


def found_by(df, **options):
    got = {}
    for r in hilbert_ann.nearest(df, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    return {q: [i for _, i in sorted(found)] for q, found in got.items()}


def recall(got, want):
    return np.mean([len(set(got[q]) & {i for _, i in found}) / len(found) for q, found in want.items()])


def test_windows_alone_find_most_where_there_is_structure(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert recall(found_by(df, every=50, k=10, block=60, windows_only=True), brute(rows, 50, 10)) >= 0.9


def test_completion_is_exact_with_and_without_structure(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "SUPER", 3)
    monkeypatch.setattr(hilbert_ann, "GROUP", 7)
    rng = np.random.default_rng(9)
    even = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(1500, 8)))]
    for rows in (clustered(1500), even):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
        got = found_by(df, every=30, k=10, block=25, curves=2)
        assert got == {q: [i for _, i in found] for q, found in brute(rows, 30, 10).items()}


def test_far_blocks_are_not_visited(spark):
    rows = clustered(600)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    far = hilbert_ann._completed(3)
    import pyarrow as pa

    def pair(bound):
        v = [np.array(x, "<f8").tobytes() for _, x in rows[:40]] + [np.full(8, 90.0, "<f8").tobytes()]
        n = len(v)
        return pa.table({"asks": [0] * 40 + [1], "k1": list(range(n)), "k2": [0] * n, "block": [0] * 40 + [9], "bound": [0.0] * 40 + [bound], "vec": v})

    assert far(pair(5.0)).num_rows == 0 and far(pair(float("inf"))).num_rows == 3 and df.count() == 600


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="needs the test tables")
def test_recall_at_the_shipped_settings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    want = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort([ids, d]) if i != q][:10]
        want[int(ids[q])] = [(float(d[i]), int(ids[i])) for i in order]
    assert recall(found_by(df), want) == 1.0


def test_empty_and_single(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert hilbert_ann.nearest(df.where("false")).count() == 0
    assert hilbert_ann.nearest(df).count() == 0
