import hashlib
import random

import pyarrow as pa
import pytest

from quern.llm import debruijn


def brute(rows):
    seen = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        for i in range(len(words) - 19):
            seen.setdefault(tuple(words[i : i + 20]), (doc, i))
    out = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - 19):
            if seen[tuple(words[i : i + 20])] < (doc, i):
                gone.update(range(i, i + 20))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[doc] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed, n=120, vocabulary=40):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(vocabulary)
    passages = [[word() for _ in range(rng.randrange(15, 70))] for _ in range(12)]
    rows = []
    for doc in range(n):
        words = []
        for _ in range(rng.randrange(0, 6)):
            words += [word() for _ in range(rng.randrange(0, 30))]
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word()
            words += p[rng.randrange(0, 5) :]
        if rng.random() < 0.05:
            words = ["a"] * rng.randrange(0, 90)
        rows.append((doc, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


def check(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeated_windows(df).collect()}
    assert got == brute(rows)


def test_matches_brute_force(spark):
    for seed in range(3):
        check(spark, corpus(seed))


def test_small_batches_agree(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(spark, corpus(7, 80))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edge_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, passage), (3, passage), (4, passage + " tail"), (None, " \t\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as tie", "3 as m", "'x' as marks")
    got = sorted(((r.id, r.n_words, r.n_removed) for r in debruijn.remove_repeated_windows(df).collect()), key=str)
    assert got == [(1, 0, 0), (2, 0, 0), (3, 30, 0), (3, 30, 0), (4, 31, 30), (None, 0, 0)]
    assert debruijn.remove_repeated_windows(df.where("false")).count() == 0


def in_one_process(rows):
    """The operator's steps by hand, with sorting in place of shuffles."""
    schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("text", pa.string())])
    docs = pa.RecordBatch.from_pylist([{"id": d, "tie": 0, "text": t} for d, t in rows], schema)

    def by_doc(batches):
        marks = {}
        for batch in batches:
            for d, m in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), strict=True):
                marks.setdefault(d, []).append(m)
        return marks

    def sort(batches, *keys):
        return pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in keys]).to_batches(max_chunksize=50)

    whole = by_doc(debruijn._bucket_stream(iter(sort(list(debruijn._occurrences([docs])), "m", "b", "id", "tie", "lo"))))
    lists = pa.list_(pa.int64())
    opened = [(d, t) for d, t in rows if any(m & 1 for m in whole.get(d, []))]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in opened]), pa.array([0] * len(opened)), pa.array([t for _, t in opened]), pa.array([whole[d] for d, _ in opened], lists)], ["id", "tie", "text", "marks"])
    edges = by_doc(debruijn._later_edges(iter(sort(list(debruijn._edges([batch])), "h1", "h2", "id", "tie", "lo")))) if opened else {}
    both = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows]), pa.array([whole.get(d) for d, _ in rows], lists), pa.array([edges.get(d) for d, _ in rows], lists)], ["id", "text", "whole", "edges"])
    return {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for b in debruijn._cleaned([both]) for r in b.to_pylist()}


@pytest.mark.parametrize("which", [None, 0, 1])
def test_words_that_collide_in_one_hash_are_told_apart(monkeypatch, which):
    """Ten words share a hash of one of the two functions, and no word passes for another."""
    true = debruijn._two_hashes

    def colliding(word):
        found = list(true(word))
        if which is not None and word[1:].isdigit():
            found[which] = true(b"group%d" % (int(word[1:]) // 10))[which]
        return tuple(found)

    monkeypatch.setattr(debruijn, "_two_hashes", colliding)
    for seed in (11, 12):
        rows = corpus(seed, 60, vocabulary=30)
        assert in_one_process(rows) == brute(rows)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in corpus(5, 60)] + [(900, None), (901, ""), (902, " a ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(debruijn.ORACLE).fetchall())
    assert sorted(tuple(r) for r in debruijn.remove_repeated_windows(df).collect()) == want
