import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


ROWS = [(1, "Hello World."), (2, "hello world."), (3, None), (4, ""), (5, "É x"), (6, "é x"), (7, "x" * 5000 + ". y"), (8, "X" * 5000 + ". Y"), (8, "X" * 5000 + ". Y"), (None, "hello WORLD."), (9, "a. " * 900), (10, "a. " * 901)]


@pytest.mark.parametrize("weak", [False, True])
def test_groups(spark, weak):
    hashed = (lambda c: F.length(c).cast("bigint") % 3) if weak else exact_dedup.chunk_hash
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "1 as recipe", "2 as n", "'z' as id")
    got = exact_dedup.exact_duplicates(df, hashed=hashed).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(fold(t), []).append(i)
    want = []
    for i, t in ROWS:
        ids = groups[fold(t)]
        want.append((i, max(x for x in ids if x is not None), len(ids), hashlib.sha256(fold(t).encode()).hexdigest()))
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert sum(r.kept for r in got) == len(groups)


def test_chunks_join_to_the_text(spark):
    for text in ("", "a", "a.b\n" * 700, "x" * 3000, "ß. \U0001f600" * 500):
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(F.array_join(exact_dedup.chunks(F.col("t")), "")).first()[0] == text


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id bigint, text string")
    got = exact_dedup.exact_duplicates(df).collect()
    assert [(r.keep_id, r.group_size) for r in got] == [(None, 2), (None, 2)] and sum(r.kept for r in got) == 1
    assert exact_dedup.exact_duplicates(df.where("false")).count() == 0
