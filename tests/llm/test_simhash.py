import random

import numpy as np
import xxhash

from quern.llm import simhash
from quern.llm.components import connected_components
from test_components import union_find

MASK = (1 << 64) - 1


def plain_fingerprint(text):
    """From the rules alone, bit by bit."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t\n\x0b\f\r]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_the_rules(monkeypatch):
    rng = random.Random(4)
    words = ["a", "B", "É", "ß", "ccc", "\x1cz", "ſ", "日本", "x-y"]
    texts = [None, "", " \t\n", "One", "one TWO three", "a b c d", "a b c d e"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for chunk in (1 << 16, 7):  # long texts are hashed piece by piece
        monkeypatch.setattr(simhash, "_CHUNK", chunk)
        assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def near_pairs(fps):
    a = np.array([f & MASK for f in fps], np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    return [(fps[i], fps[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(rng, base, n, among=range(64)):
    for b in rng.sample(list(among), n):
        base ^= 1 << b
    return base


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(400)} | {0, flipped(rng, 0, 4), flipped(rng, 0, 5), MASK}
    for _ in range(60):  # chains, whose ends may lie far apart
        at = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            fps.add(at)
            at = flipped(rng, at, rng.randrange(1, 6))
    # buckets with more members than are compared pairwise: many variants inside one block of bits
    base = rng.getrandbits(64)
    crowd = {base ^ (1 << i) ^ (1 << j) for i in range(22) for j in range(22)} | {base ^ (1 << i) ^ (1 << j) for i in range(22, 43) for j in range(43, 64)}
    assert len(crowd) > 2 * simhash.BUCKET
    fps |= crowd | {flipped(rng, x, 4) for x in rng.sample(sorted(crowd), 40)}
    fps = sorted(map(signed, fps))
    got = connected_components(simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint")))
    assert {r.node: r.component for r in got.collect()} == union_find(near_pairs(fps))


def test_links_are_true(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = sorted({signed(flipped(rng, base, n)) for n in (0, 1, 2, 3, 4, 5, 6) for _ in range(60)})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()
    assert links and all(((r.u ^ r.v) & MASK).bit_count() <= 4 for r in links)


def brute_components(rows):
    """(id, text) rows to (fingerprint, smallest id reachable), null ids last."""
    fp = [signed(plain_fingerprint(t)) for _, t in rows]
    root = union_find(near_pairs(sorted(set(fp))))
    least = {}
    for (i, _), f in zip(rows, fp, strict=True):
        r = root.get(f, f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f, least.get(root.get(f, f))) for (i, _), f in zip(rows, fp, strict=True)]


def test_tables(spark):
    rng = random.Random(3)
    prose = [["w%d" % rng.randrange(300) for _ in range(150)] for _ in range(30)]
    rows = [(i, " ".join(p)) for i, p in enumerate(prose)]
    for i, p in enumerate(prose[:20]):  # near copies, by one word
        q = list(p)
        q[rng.randrange(len(q))] = "changed"
        rows.append((100 + i, " ".join(q)))
    rows += [(500, None), (501, ""), (502, "  \n"), (None, rows[0][1]), (None, None), (7, rows[7][1]), (7, rows[8][1]), (900, "long text " * 40_000), (901, "LONG Text " * 40_000)]
    rows += [(2000 + i, rows[3][1]) for i in range(300)]  # a third of all rows are one text
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as fp", "3 as component", "'x' as variant").repartition(4)
    got = sorted(((r.id, r.fp, r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)
    first = [r for r in simhash.near_duplicates(df).collect() if r.is_first]
    assert {r.id for r in first} == {c for _, _, c in got if c is not None}
    assert simhash.near_duplicates(df.where("false")).count() == 0
