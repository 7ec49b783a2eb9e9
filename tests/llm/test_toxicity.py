import math
import os
import random

import numpy as np
import pytest

from quern.llm import toxicity


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu"]) for _ in range(rng.randrange(1, 5)))
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = [word() for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorg", "grumf", "xxiv" + word()]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_learns_planted_words(spark):
    rows = corpus()
    # many copies of one toxic text must not turn its plain words into evidence
    copied = (0, "plain words alone repeated often zorg zorg", 1)
    train = spark.createDataFrame(rows[:400] + [(1000 + i, *copied[1:]) for i in range(30)], "doc_id bigint, text string, toxic int")
    model = toxicity.fit(train)
    assert "plain$" not in model.entries and any(e.startswith("zor") for e in model.entries)
    test = spark.createDataFrame(rows[400:], "doc_id bigint, text string, toxic int").selectExpr("*", "0 as score", "1 as id")
    got = {r.id: r for r in toxicity.predict(test, model).collect()}
    right = sum(got[i].predicted == t for i, _, t in rows[400:])
    assert right >= 97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_label_model_weighs_correlated_voters_less():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = [(rng.random(4000) < np.where(y, 0.8, 0.02)).astype(np.int8) for _ in range(3)]
    bad = (rng.random(4000) < 0.1).astype(np.int8)
    v = np.stack([*good, bad, bad, np.where(sum(good) + bad > 0, 0, -1)], axis=1)
    q = toxicity.label_model(v, 0.3)
    assert ((q > 0.5) == y).mean() > 0.9


def test_edge_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, toxic int")
    model = toxicity.fit(none)
    rows = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "w " * 200000)], "doc_id bigint, text string")
    assert toxicity.predict(rows, model).count() == 4
    assert {r.predicted for r in toxicity.predict(rows, model).collect()} == {0}
    assert toxicity.fit(spark.createDataFrame([(1, "a", 1), (2, None, 0), (3, "b", None)], "doc_id bigint, text string, toxic int")).entries == []


def plain_label_model(v, prior, rounds=50):
    """The same model text by text and voter by voter, without matrices."""
    n, m = v.shape
    total = [sum(int(x) for x in row) for row in v]
    bound = min(np.quantile(total, 1 - prior), max(total) - 1)
    q = [0.9 if t > bound else 0.1 for t in total]
    for _ in range(rounds):
        rate = {}
        for side in (0, 1):
            mass = [q[i] if side == 0 else 1 - q[i] for i in range(n)]
            for j in range(m):
                for kind in (1, -1):
                    rate[side, j, kind] = (sum(mass[i] for i in range(n) if v[i][j] == kind) + 0.1) / (sum(mass) + 0.3)
        left = [[(v[i][j] != 0) - q[i] * (rate[0, j, 1] + rate[0, j, -1]) - (1 - q[i]) * (rate[1, j, 1] + rate[1, j, -1]) for j in range(m)] for i in range(n)]
        spread = [math.sqrt(sum(r[j] ** 2 for r in left) / n) + 1e-6 for j in range(m)]
        weight = []
        for j in range(m):
            alike = [abs(sum(r[j] * r[k] for r in left) / n / spread[j] / spread[k]) for k in range(m) if k != j]
            weight.append(1 / (1 + sum(a for a in alike if a > 0.2)))
        new = []
        for i in range(n):
            odds = math.log(prior / (1 - prior))
            for j in range(m):
                kind = int(v[i][j])
                chance = [rate[s, j, kind] if kind else min(1, max(1e-6, 1 - rate[s, j, 1] - rate[s, j, -1])) for s in (0, 1)]
                odds += weight[j] * (math.log(chance[0]) - math.log(chance[1]))
            new.append(1 / (1 + math.exp(-min(30, max(-30, odds)))))
        moved = max(abs(a - b) for a, b in zip(q, new, strict=True))
        q = new
        if moved < 1e-4:
            break
    return q


def test_label_model_matches_plain_em():
    rng = np.random.default_rng(6)
    y = rng.random(150) < 0.3
    votes = np.stack([(rng.random(150) < np.where(y, hit, miss)).astype(np.int8) for hit, miss in ((0.8, 0.05), (0.6, 0.02), (0.6, 0.02), (0.2, 0.2))], axis=1)
    votes[:, 2] = votes[:, 1]  # one voter repeats another
    votes = np.hstack([votes, np.where(votes.sum(axis=1, keepdims=True), 0, -1).astype(np.int8)])
    assert np.allclose(toxicity.label_model(votes, 0.3), plain_label_model(votes, 0.3), atol=1e-6)


def test_lexicon_and_features_match_the_text():
    lexicon = toxicity.Lexicon(["bad$", "wor", "xy$"])
    hits, words = lexicon.hits("Bad badly WORSE worst. xy, bad-xy 12 xyz")
    assert words == 8 and hits == {0: 2, 1: 2, 2: 2}
    assert lexicon.hits(None) == ({}, 0)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="needs the test tables")
def test_held_out_labels_of_the_tables(spark):
    """Labels that the fit has not seen: almost all toxic rows are caught and clean ones left alone."""
    d = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.op7_toxicity(spark, d).where("held_out").join(marks, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert len(toxic) > 50 and len(clean) > 500
    assert np.mean([r.predicted for r in toxic]) >= 0.9 and np.mean([r.predicted for r in clean]) <= 0.01
    # ranking: a toxic row scores above a clean one; a tie counts half
    scores = np.array([r.score for r in got])
    a, b = scores[np.array([r.toxic for r in got]) > 0], scores[np.array([r.toxic for r in got]) == 0]
    area = ((a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2).item()
    assert area > 0.95
