import random
from collections import Counter

import corpus_pipeline as pipeline


def test_stages_on_a_small_table(spark, tmp_path):
    prose = ["w%d" % (i * i % 97) for i in range(300)]
    near = prose[:150] + ["changed"] + prose[151:]
    rows = [
        (1, " ".join(prose), "en", "src0", 1), (2, " ".join(prose).upper(), "en", "src1", 1), (2, " ".join(prose).upper(), "en", "src1", 1),
        (3, " ".join(near), "en", "src1", 1), (4, "short text", "de", None, 1), (5, None, None, "src2", 0), (6, "", "en", "src2", 0), (7, "another " * 4000, "en", "srcX", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    left = {}
    for name, stage in pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        left[name] = Counter(r.doc_id for r in kept.collect())
    assert left["toxicity"] == Counter(r[0] for r in rows)
    assert left["exact_dedup"] == Counter([2, 3, 4, 6, 7])
    assert left["simhash_near_dedup"] == Counter([2, 4, 6, 7]) == left["mix"]
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == {2, 4, 6, 7}
    assert pipeline.run(spark, str(tmp_path)).columns == out.columns


def test_stages_are_the_five_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mix", "pack"]


def test_near_copies_are_named_by_row(spark, tmp_path):
    prose = ["w%d" % (i * i % 97) for i in range(300)]
    texts = [" ".join([*prose[:150], f"changed{i}", *prose[151:]]) for i in range(4)]
    other = " ".join("v%d" % (i * 7 % 89) for i in range(300))
    lone = " ".join("u%d" % (i * 5 % 83) for i in range(300))
    rows = [(1, texts[0]), (None, texts[1]), (None, "clean text of no id at all"), (1, texts[2]), (1, lone), (None, other), (None, other + " end"), (None, None), (9, texts[3]), (9, "clean text of a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same = {r.fp for r in pipeline.simhash.fingerprints(docs.where("text like '%changed%'")).collect()}
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a in same for b in same)
    got = Counter((r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs.union(docs), str(tmp_path)).collect())
    assert set(got.values()) == {1}
    assert {k for k in got if k[1] and "changed" in k[1]} <= {rows[0], rows[3]} and sum("changed" in (k[1] or "") for k in got) == 1
    assert sum((k[1] or "").startswith(other) for k in got) == 1
    assert {rows[2], rows[4], rows[7], rows[9]} <= set(got) and len(got) == 6


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline.packing, "RANGE_SLOTS", 6)
    rng = random.Random(3)
    rows = []
    for source, n in (("src0", 900), ("src7", 450)):
        # a source's texts share all their words, so that every sketch of one is alike
        words = [f"{source}{chr(97 + k)}" for k in range(26)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=400) + words), "en", source, 1) for i in range(n)]
    rows.append((None, "no id " * 60, "en", "src7", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    source = {r[0]: r[3] for r in rows}
    assert {r.doc_id for r in out} == set(source)
    tokens, run, worst = Counter(), Counter(), 0
    for r in out:
        tokens[r.sequence_id] += r.length
    share = Counter()
    for r in out:
        share[source[r.doc_id]] += r.length
    whole = sum(share.values())
    # 2 : 1 in every stretch of the sequences, up to one range of slots
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        run[source[r.doc_id]] += r.length
        worst = max(worst, abs(run["src0"] - sum(run.values()) * share["src0"] / whole))
    slots = sum(len(r[1]) for r in rows) / pipeline.pfair.BLOCK_CHARS
    assert 0.6 < share["src0"] / whole < 0.7
    assert worst < 4 * whole / slots, worst * slots / whole
    assert len({s >> 40 for s in tokens}) == -(-slots // 6)
    assert max(tokens.values()) <= 2048
