import heapq
import random

import numpy as np
import pytest

from quern.llm import chat

LEGAL = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}


def cheapest(roles):
    """Shortest path over (turns read, state), from the rules alone: costs are written out here."""
    heap, seen = [(0.0, 0, "start")], set()
    while heap:
        cost, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(roles) and state in ("start", "assistant"):
            return cost
        for to in LEGAL[state]:
            heapq.heappush(heap, (cost + 2.5, at, to))
        if at < len(roles):
            role = roles[at]
            for to in LEGAL[state]:
                heapq.heappush(heap, (cost + (0 if role == to else 2 if role else 0.5), at + 1, to))
            if state != "start":
                heapq.heappush(heap, (cost + (1 if role == state else 3 if role else 1.5), at + 1, state))


def legal(text):
    roles = [x.split("|>")[0] for x in text.split("<|") if x and not x.startswith("end|>")]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return roles == ["user", "assistant"] * (len(roles) // 2)


KNOWN = {"system": "system", "user": "user", "Human": "user", "assistant": "assistant"}


def conversations(seed=2, n=60, most=7):
    rng = random.Random(seed)
    names = ["system", "user", "assistant", "tool", None, "Human"]
    return {c: [rng.choice(names) for _ in range(rng.randrange(1, most))] for c in range(n)}


def repaired(spark, convs, parts, batch=None):
    rows = [(c, t, r, f"text {c} {t}.") for c, roles in convs.items() for t, r in enumerate(roles)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as part", "2 as code", "3 as place")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    if batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        return sorted((tuple(r) for r in chat.repair(df).collect()), key=lambda r: (r[0], r[2]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cheapest_legal_path_however_it_is_split(spark, monkeypatch):
    convs = conversations() | {1000: conversations(5, 1, 2)[0] + [random.Random(4).choice(["user", "assistant", None]) for _ in range(90)]}
    found = [repaired(spark, convs, 1), repaired(spark, convs, 37), repaired(spark, convs, 5, batch=3)]
    monkeypatch.setattr(chat, "SHORT", 2)
    found.append(repaired(spark, convs, 11))
    # ties too fall the same way wherever partitions and batches end
    assert all(f == found[0] for f in found[1:])
    got = {}
    for conv, turn, place, role, *rest in found[0]:
        assert place == turn and role == convs[conv][turn]
        got.setdefault(conv, []).append(rest)
    for c, roles in convs.items():
        assert len(got[c]) == len(roles)
        assert sum(r[2] for r in got[c]) == pytest.approx(cheapest([KNOWN.get(x) for x in roles]))
        text = "".join(r[3] for r in got[c])
        assert legal(text) and text.count("<|end|>") == text.count("<|") / 2
        for t in range(len(roles)):
            assert f"text {c} {t}." in text


def test_stretches_compose_to_the_whole():
    rng = np.random.default_rng(3)
    for _ in range(30):
        codes = rng.integers(0, 4, 23)
        whole = chat._reduced(codes)
        for cut in (1, 7, 22):
            parts = [tuple(x[None] for x in chat._reduced(c)) for c in (codes[:cut], codes[cut:])]
            joined = chat._composed(*parts)
            assert (joined[0][0] == whole[0]).all()
            live = whole[0] < chat._INF
            assert (joined[1][0][live.all(axis=0)[None, :].repeat(4, 0)] == whole[1][live.all(axis=0)[None, :].repeat(4, 0)]).all()


def test_clean_conversation_is_unchanged(spark):
    df = spark.createDataFrame([("c", 0, "system", "s"), ("c", 1, "user", "q"), ("c", 2, "assistant", "a")], "conv_id string, turn bigint, role string, text string")
    got = sorted(chat.repair(df).collect(), key=lambda r: r.turn)
    assert {r.action for r in got} == {"keep"} and sum(r.cost for r in got) == 0
    assert "".join(r.rendered for r in got) == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n"


def test_edge_rows(spark):
    rows = [(None, None, None, None), (None, -1, "user", "n"), (None, 1, "user", ""), (2, 1, "user", "a"), (2, 1, "user", "a"), (3, 5, "assistant", "only"), (4, 0, "user", "w " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.repair(df).collect()
    assert len(got) == len(rows)
    null = sorted((r for r in got if r.conv is None), key=lambda r: r.place)
    assert [r.turn for r in null] == [None, -1, 1]
    assert sorted(r.place for r in got if r.conv == 2) == [0, 1]
    assert "".join(r.rendered for r in got if r.conv == 3) == "<|user|>\n<|end|>\n<|assistant|>\nonly<|end|>\n"
    assert chat.repair(df.where("false")).count() == 0


def test_many_turns_of_one_number(spark):
    n = 100_000
    df = spark.range(n).selectExpr("7 as conv_id", "cast(null as bigint) as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "'same' as text")
    got = chat.repair(df)
    assert got.selectExpr("count(*)", "count(distinct place)", "min(place)", "max(place)").first()[:] == (n, n, 0, n - 1)
    from pyspark.sql import functions as F

    # sorted by role: all assistants, then all users
    assert got.groupBy("action").agg(F.count("*").alias("n")).orderBy("action").first() is not None
    total = got.agg(F.sum("cost")).first()[0]
    users = -(-n // 3)
    assert total == cheapest(["assistant"] * 3 + ["user"] * 2) + (n - users - 3) + (users - 2)
