import functools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quern.llm import packing


@functools.cache
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encode(text):
    return [*model().encode(text or "", add_special_tokens=False).ids, 1]


def texts(seed=5, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ'") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    signs = [" ", "\n", "  ", "\t", ", ", ". ", " ", " ", "\x1c", "'s ", "<|endoftext|>", "3 ", "é ", "İ "]
    out = [None, "", " ", "x", "x", "long " * 9000]
    out += ["".join(rng.choice(words) + rng.choice(signs if rng.random() < 0.2 else [" "]) for _ in range(rng.randrange(1, 900))) for _ in range(n)]
    return list(enumerate(out))


@pytest.mark.parametrize("shard_docs", [4000, 20])
def test_every_id_lies_in_one_piece(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(packing, "SHARD_DOCS", shard_docs)  # local workers fork after this only if none ran before
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 as tokens", "2 as id")
    got = packing.pack(df).collect()
    ids = {i: encode(t) for i, t in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            part = np.array(ids[i][at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids[i])
    short = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        short += at <= 2048 - packing.STEP
    assert short <= 1


def test_neighbours_share_rare_words():
    words = [np.array(w, np.uint32) for w in ([1, 2, 50], [1, 3, 60], [1, 4, 50], [1, 5, 60], [1, 6, 70])]
    shard = packing._Shard(words, [np.ones(3, np.uint16)] * 5)
    unused = np.ones(5, bool)
    unused[0] = False
    assert next(shard.neighbours(0, unused)) == 2
    packer = packing._Packer(2048)
    packer.pack(np.array([1000, 1000, 1048, 1048, 100]), shard)
    windows = {}
    for doc, _, _, sequence, _ in packer.pieces:
        windows.setdefault(sequence, []).append(doc)
    assert windows[0] == [0, 2] and windows[1] == [1, 3] and windows[2] == [4]


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], "doc_id bigint, text string")
    assert sorted(r.length for r in packing.pack(df).collect()) == [2, 4, 4]
    assert packing.pack(df.where("false")).count() == 0


def test_statistics_are_of_the_whole_corpus_and_queries_whole(spark):
    rows = [(i, "common " + ("rare " if i % 5 == 0 else "") + f"own{i} common") for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    ready = df.mapInArrow(packing._tokenised(public_tokenizers.path("word_bpe_49k.json")), packing._TOKENISED).selectExpr("*", "cast(coalesce(id, 0) % 2 as int) as task")
    found = packing.corpus_statistics(ready, 2).collect()
    for task in (0, 1):
        corpus = packing._Corpus.listed(*(np.array([r[k] for r in found if r.task == task]) for k in (1, 2)))
        assert corpus.docs == 41 and sorted(corpus.df.tolist()) == [8, 40]
        assert corpus.mean == sum(len((t or "").split()) for _, t in rows) / 41
    # two words as frequent as each other in the shard, but not in the corpus
    words = [np.array(w, np.uint32) for w in ([1, 2], [1, 3], [2, 4])]
    known = packing._Corpus(np.array([1, 2], np.uint32), np.array([900, 2]), 1000, 2.0)
    unused = np.array([False, True, True])
    assert list(packing._Shard(words, [np.ones(2, np.uint16)] * 3, known).neighbours(0, unused)) == [2, 1]
    known.df = known.df[::-1]
    assert list(packing._Shard(words, [np.ones(2, np.uint16)] * 3, known).neighbours(0, unused)) == [1, 2]
    # thirty rarer words of the seed do not hide a neighbour that shares only the commonest one
    words = [np.arange(31, dtype=np.uint32), np.array([0, 50], np.uint32), *(np.array([0, k], np.uint32) for k in range(1, 31))]
    shard = packing._Shard(words, [np.ones(len(w), np.uint16) for w in words])
    assert 1 in shard.neighbours(0, np.arange(len(words)) > 0)


def plain_bm25(words, counts, seed):
    n, lengths = len(words), [sum(c.tolist()) for c in counts]
    mean, out = sum(lengths) / n, [0.0] * n
    for w in words[seed].tolist():
        df = sum(w in x.tolist() for x in words)
        if df == 1:
            continue
        for d in range(n):
            for x, tf in zip(words[d].tolist(), counts[d].tolist(), strict=True):
                if x == w:
                    out[d] += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / mean))
    return out


def test_scores_are_plain_bm25():
    rng = np.random.default_rng(2)
    words = [np.unique((rng.zipf(1.4, 40) % 200).astype(np.uint32)) for _ in range(120)]
    counts = [rng.integers(1, 300, len(w)).astype(np.uint32) for w in words]
    shard = packing._Shard(words, counts)
    assert 0 < shard.matrix.shape[1] and len(shard.docs)  # both ways of scoring are met
    unused = rng.random(120) < 0.7
    for seed in (0, 3, 90, 119):
        want = plain_bm25(words, counts, seed)
        assert np.allclose(shard.scores(seed, unused), want, rtol=1e-4)
        got = list(shard.neighbours(seed, unused))
        assert sorted(got) == [d for d in range(120) if unused[d] and want[d] > 0]
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got[:-1], got[1:], strict=True))


def test_hot_sketches_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "HOT_ROWS", 10)
    rows = [(i, 1, 1) for i in range(95)] + [(100 + i, 2, i) for i in range(5)]
    df = spark.createDataFrame(rows, "spread bigint, sketch bigint, sketch2 bigint")
    for bound in (100, 0):
        monkeypatch.setattr(packing, "HOT_BROADCAST", bound)
        got = packing._with_salt(df).collect()
        assert len(got) == 100 and {r.salt for r in got if r.sketch == 2} == {0}
        assert len({r.salt for r in got if r.sketch == 1}) > 5 and max(r.salt for r in got) < 10


def test_counts_over_255_and_remembered_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "_WORDS", 50)
    tokens = packing._Tokens(public_tokenizers.path("word_bpe_49k.json"))
    for seed in range(4):
        some = [t or "" for _, t in texts(seed, 20)]
        ids, size, _, n = tokens.of(pa.array(some))
        at = np.append(0, np.cumsum(size))
        for t, a, b in zip(some, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == encode(t)
    words, counts, n = packing._counted(np.array([5] * 300 + [7], np.uint32), np.array([300, 0, 1]))
    assert words.tolist() == [5, 7] and counts.tolist() == [300, 1] and n.tolist() == [1, 0, 1]


def test_merges_are_those_of_the_library():
    import pyarrow as pa

    from quern.llm.word_bpe import Merges

    rng = random.Random(8)
    some = ["a", "é", "th", "the", "ß" * 40] + ["".join(rng.choice("etaoinéßthrwüz") for _ in range(rng.randrange(1, 30))) for _ in range(6000)]
    flat, size = Merges.of(model().to_str()).encode(pa.array(["x", *some]).slice(1))
    at = np.append(0, np.cumsum(size))
    for word, a, b in zip(some, at[:-1], at[1:], strict=True):
        assert flat[a:b].tolist() == encode(word)[:-1]
    tokens = packing._Tokens(public_tokenizers.path("word_bpe_49k.json"))
    long = pa.array(["the", "a" * 300, "thé"])  # one word over the limit: the library's way
    ids, sizes = tokens._encoded(long)
    assert ids.tolist() == [i for w in long.to_pylist() for i in encode(w)[:-1]] and sizes.sum() == len(ids)
    assert Merges.of('{"model": {"type": "Unigram"}}') is None
