import math

import pytest
from pyspark.sql import functions as F

from quern.operators import fusion, fuzzy, index, lexical
from quern.operators.search import Engine, Index

FIELDS = "array<struct<name:string,value:string>>"
SCHEMA = f"note_id bigint, fields {FIELDS}, tags array<string>, decks array<string>, note_type string, card_ids array<bigint>, title string"


def notes(spark, rows):
    return spark.createDataFrame([(i, list(f.items()), tags, decks, kind, [i + 1000], None) for i, f, tags, decks, kind in rows], SCHEMA)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        (1001, {"Text": "{{c1::Bupropion}} is used for smoking cessation", "Extra": "<b>Wellbutrin</b> helps"}, ["Psychiatry"], ["AnyDeck::Step 2"], "Cloze"),
        (1002, {"Front": "heart failure with preserved function", "Back": "diuretics"}, ["Cardiology"], ["AnyDeck::Step 1"], "Basic"),
        (1003, {"Front": "failure of the left heart", "Back": "sleep and rest"}, ["Cardiology"], ["Other"], "Basic"),
        (1004, {"Front": "smoking and bupropion", "Back": "bupropion again"}, ["Psychiatry"], ["Other"], "Basic"),
    ]
    aliases = spark.createDataFrame([("zyban", "bupropion"), ("chf", "heart failure")], "alias string, canonical string")
    return Engine(spark, Index.build(notes(spark, rows), aliases))


def found(engine, text, **how):
    return engine.search([text], field_names=["Text", "Front"], **how).orderBy("position").collect()


def test_phrase_reasons(engine):
    rows = found(engine, '"heart failure"')
    assert [r.note_id for r in rows] == [1002]
    assert {"exact_phrase", "proximity"} <= {x.kind for x in rows[0].reasons}
    weights = [x.weight for x in rows[0].reasons]
    assert weights == sorted(weights, reverse=True) and rows[0].reasons[0].label


def test_correction_and_alias(engine):
    rows = found(engine, "bupropoin smoking")
    assert {r.note_id for r in rows} == {1001, 1004} and all("typo" in {x.kind for x in r.reasons} for r in rows)
    assert {r.note_id for r in found(engine, "zyban")} == {1001, 1004}
    assert found(engine, "zyban", mode="exact") == []


def test_negative_and_filters(engine):
    assert [r.note_id for r in found(engine, "heart -sleep")] == [1002]
    everything = {r.note_id: r.score for r in found(engine, "heart failure")}
    masked = {r.note_id: r.score for r in found(engine, "heart failure deck:Other")}
    assert masked == {1003: everything[1003]}  # a mask changes no score
    assert found(engine, "heart rated:3") == []  # a filter that cannot be applied
    only = found(engine, "tag:cardiology")
    assert [(r.note_id, r.score, [x.kind for x in r.reasons], r.total_candidates) for r in only] == [(1002, 1.0, ["filter"], 2), (1003, 1.0, ["filter"], 2)]


def test_structure_that_ranking_would_lose_is_evaluated_exactly(engine):
    for mode in ("smart", "exact", "semantic"):
        rows = found(engine, "heart OR wellbutrin", mode=mode)
        assert [(r.note_id, r.score, [x.kind for x in r.reasons]) for r in rows] == [(i, None, ["native"]) for i in (1001, 1002, 1003)], mode
    assert [r.note_id for r in found(engine, "(heart -sleep) failure")] == [1002]
    both = engine.search(["heart OR wellbutrin", "heart"], field_names=["Text"]).collect()
    assert {(r.query_id, r.note_id) for r in both} == {(0, 1001), (0, 1002), (0, 1003), (1, 1002), (1, 1003)}


def test_warnings_unfinished_filters_and_key_aliases(engine):
    got = engine.warnings(["bupropoin", "a OR b", 'x "y', "heart rated:3", "heart is:"], typing=True).collect()
    assert {(r.query_id, r.warning) for r in got} == {(0, "corrected"), (1, "evaluated_exactly"), (2, "unmatched_quote"), (3, "filter_not_applied"), (4, "unfinished_filter")}
    assert {r.note_id for r in found(engine, "heart is:", typing=True)} == {1002, 1003} and found(engine, "heart is:") == []
    assert [r.note_id for r in found(engine, "notetype:Cloze")] == [1001]


def test_semantic_reason_and_responses(spark, engine):
    hits = spark.createDataFrame([(0, 1003, 1, 0.9), (0, 1004, 2, 0.4)], "query_id int, note_id bigint, rank int, similarity double")
    rows = found(engine, "heart", mode="semantic", semantic=hits)
    assert [(r.note_id, [(x.kind, x.weight) for x in r.reasons if x.kind == "semantic"]) for r in rows] == [(1003, [("semantic", 0.9)]), (1004, [("semantic", 0.4)])]
    results = engine.search(["heart"])
    assert {(r.note_id, tuple(r.card_ids), r.truncated) for r in engine.responses(results).collect()} == {(1002, (2002,), False), (1003, (2003,), False)}
    scope = spark.createDataFrame([(1003, 9), (1003, 8), (1001, 7)], "note_id bigint, card_id bigint")
    assert [(r.note_id, r.card_ids, r.truncated) for r in engine.responses(results, scope, limit=1).collect()] == [(1003, [8, 9], True)]


def test_published_index_equals_a_built_one(spark, engine, tmp_path):
    from quern.operators.versions import Versions

    v = Versions(spark, str(tmp_path / "index"))
    rows = [
        (1001, {"Text": "{{c1::Bupropion}} is used for smoking cessation", "Extra": "<b>Wellbutrin</b> helps"}, ["Psychiatry"], ["AnyDeck::Step 2"], "Cloze"),
        (1002, {"Front": "heart failure with preserved function", "Back": "diuretics"}, ["Cardiology"], ["AnyDeck::Step 1"], "Basic"),
        (1003, {"Front": "failure of the left heart", "Back": "sleep and rest"}, ["Cardiology"], ["Other"], "Basic"),
        (1004, {"Front": "smoking and bupropion", "Back": "bupropion again"}, ["Psychiatry"], ["Other"], "Basic"),
    ]
    aliases = spark.createDataFrame([("zyban", "bupropion"), ("chf", "heart failure")], "alias string, canonical string")
    index.publish(v, notes(spark, rows), aliases, shards=3)
    published = Engine(spark, Index.open(v))
    texts = ["heart failure", '"heart failure" -sleep', "zyban", "bupropoin smoking", "tag:cardiology", "chf", "nothing here"]
    show = lambda e: sorted((r.query_id, r.position, r.note_id, r.score, str(r.reasons), r.title, r.total_candidates) for r in e.search(texts).collect())
    assert show(published) == show(engine)


def test_a_search_reads_the_index_and_no_documents(spark):
    from quern import queries

    d = "/root/testdata/sf0.001"
    for name in ("bm25_topk_single", "bm25_topk_or", "bm25_phrase", "rrf_fusion", "smart_search", "fuzzy_candidates"):
        files = set(queries.queries()[name](spark, d).inputFiles())
        assert not any("documents.parquet" in f for f in files), name


def test_exact_expression(engine):
    assert [r.note_id for r in engine.exact("heart OR wellbutrin").collect()] == [1001, 1002, 1003]


def test_bm25_formula(spark):
    rows = [(1, {"Text": "alpha beta beta"}, [], [], ""), (2, {"Text": "beta gamma"}, [], [], ""), (3, {"Text": "delta"}, [], [], "")]
    prepared = index.prepare(notes(spark, rows))
    stats = index.doc_stats(prepared)
    n, mean = lexical.corpus_size(stats)
    lens = {r.note_id: r.len for r in stats.collect()}
    assert lens == {1: 6, 2: 4, 3: 2} and mean == 4  # title and body
    counts = index.term_counts(prepared)
    terms = counts.groupBy("term").agg(F.count("*").alias("df"))
    asked = spark.createDataFrame([(7, 0, "alpha"), (8, 0, "beta"), (8, 1, "gamma"), (9, 0, "none")], "query_id int, group_id int, term string")
    got = {(r.query_id, r.note_id): (r.score, r.groups) for r in lexical.matched(lexical.word_parts(counts, terms, asked, (n, mean))).collect()}

    def part(df, f, length):
        idf = max(math.log((3 - df + 0.5) / (df + 0.5)), 0) or 1e-6
        return -idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / 4))

    assert set(got) == {(7, 1), (8, 1), (8, 2)}
    assert got[7, 1] == (pytest.approx(part(1, 11, 6)), 1) and got[8, 1] == (pytest.approx(part(2, 22, 6)), 1)
    assert got[8, 2] == (pytest.approx(part(2, 11, 4) + part(1, 11, 4)), 2)
    phrases = spark.createDataFrame([(1, ["beta", "beta"]), (2, ["beta", "gamma"]), (3, ["gamma", "beta"])], "phrase_id int, tokens array<string>")
    hits = {(r.phrase_id, r.note_id): r.wf for r in lexical.phrase_hits(index.postings(prepared), phrases, terms).collect()}
    assert hits == {(1, 1): 11.0, (2, 2): 11.0}


def corrections(spark, vocabulary, *tokens):
    v = spark.createDataFrame(vocabulary, "term string, frequency bigint, trusted boolean")
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    return {r.token: r for r in fuzzy.corrections(fuzzy.suggestions(asked, v)).collect()}


def test_corrections(spark):
    got = corrections(spark, [("bupropion", 30, False), ("buspirone", 2, False)], "buproprion", "cat")
    assert (got["buproprion"].corrected, got["buproprion"].distance, got["buproprion"].automatic) == ("bupropion", 1, True)
    assert "cat" not in got
    got = corrections(spark, [("ilium", 1, False), ("ileum", 100, False)], "ilium")
    assert got["ilium"].corrected == "ileum" and not got["ilium"].automatic
    assert corrections(spark, [("validterm", 4, False), ("validterma", 10, True)], "validterm") == {}
    got = corrections(spark, [("buproprion", 4, False), ("bupropion", 66, True)], "buproprion")
    assert got["buproprion"].automatic


def test_boosts(spark):
    words = "array<string>"
    rows = [(1, 0.0, "a x b", ["a", "x", "b"], ["a"], ["a", "b"], []), (2, 0.0, "a", ["a"], ["a"], ["a", "b"], []), (3, 0.0, "a", ["a"], ["a"], ["a"], []), (4, 0.0, "x b a", ["x", "b", "a"], ["b", "a"], ["a", "b"], ["b a"])]
    df = spark.createDataFrame(rows, f"note_id bigint, score double, normalized_text string, tokens {words}, title_tokens {words}, query_tokens {words}, phrases {words}")
    got = {r.note_id: (r.score, r.proximity) for r in fusion.boosted(df).collect()}
    near = lambda span: 0.018 / max(1, math.log2(span + 1))
    want = {1: (0.035 + near(3), near(3)), 2: (0.0, 0.0), 3: (0.035 + 0.02, 0.0), 4: (0.055 + 0.035 + 0.02 + near(2), near(2))}
    assert {i: (pytest.approx(a), pytest.approx(b)) for i, (a, b) in want.items()} == got


def test_cover_span():
    assert fusion.cover_span("a x b a".split(), ["a", "b"]) == 2
    assert fusion.cover_span("a x b a".split(), ["a", "a", "b"]) == 4
    assert fusion.cover_span(["a"], ["b"]) is None


def test_semantic_cutoff(spark):
    scores = [0.90, 0.86] + [0.50] * 18
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores, 1)], "query_id int, note_id bigint, similarity double")
    assert sorted(r.note_id for r in fusion.semantic_cutoff(rows).collect()) == [1, 2]
    assert fusion.semantic_cutoff(rows.where("note_id <= 12")).count() == 12


def test_coverage_cutoff(spark):
    rows = spark.createDataFrame([(0, 1, 5, {"literal_broad": 1}), (0, 2, 4, {"literal_broad": 2}), (0, 3, 3, {"literal_broad": 3}), (0, 4, 1, {"alias": 1})], "query_id int, note_id bigint, matched int, source_ranks map<string,int>")
    assert sorted(r.note_id for r in fusion.smart_cutoff(rows).collect()) == [1, 2, 4]


def test_alias_intersection(spark):
    rows = [("x", "X", 1, "a"), ("x", "X", 1, "b"), ("x", "Xx", 2, "b"), ("y", "Y", 3, "c"), ("y", "Y", 4, "d"), ("z", "Z", 5, "e"), ("z", "Z", 6, "e")]
    got = fuzzy.shared_ingredients(spark.createDataFrame(rows, "alias string, surface string, item int, ingredient string")).collect()
    assert sorted((r.alias, r.surface, r.ingredient) for r in got) == [("x", "X", "b"), ("z", "Z", "e")]


def test_upsert_plan_merge_and_versions(spark, tmp_path):
    s = "note_id bigint, content_hash string, card_scope_hash string"
    stored = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "s"), (4, "d", "s")], s)
    incoming = spark.createDataFrame([(1, "a", "s"), (2, "B", "s"), (3, "c", "S"), (5, "e", "s")], s)
    plan = index.plan_upsert(incoming, stored)
    assert {r.note_id: r.action for r in plan.collect()} == {1: "unchanged", 2: "update", 3: "rescope", 4: "missing", 5: "insert"}
    merged = {tuple(r) for r in index.merge(stored, incoming, plan).collect()}
    assert merged == {(1, "a", "s"), (2, "B", "s"), (3, "c", "S"), (5, "e", "s")}
    v = index.Versions(spark, str(tmp_path / "idx"))
    assert v.current() == 0
    v.publish({"notes": stored})
    assert v.publish({"notes": index.merge(v.read("notes"), incoming, plan)}, content_changed=False) == 2
    assert v.read("notes").count() == 4 and v.generation() == 1


def test_versions_survive_a_failure_and_refuse_a_second_writer(spark, tmp_path, monkeypatch):
    from quern.operators.versions import Conflict, Versions

    v = Versions(spark, str(tmp_path / "v"))
    v.publish({"t": spark.range(3)}, keys={"a": 1})
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        v.publish({"t": broken})
    assert v.current() == 1 and v.read("t").count() == 3
    with monkeypatch.context() as m:  # the tables are written, but the entry is not
        m.setattr(Versions, "_append", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            v.publish({"t": spark.range(9)})
    assert v.current() == 1 and v.read("t").count() == 3
    late = Versions(spark, str(tmp_path / "v"))
    seen = late.entry()
    v.publish({"t": spark.range(4)}, content_changed=False, keys={"b": 2})
    with monkeypatch.context() as m:
        m.setattr(late, "entry", lambda version=None: seen)
        with pytest.raises(Conflict):
            late.publish({"t": spark.range(5)})
    assert v.current() == 2 and v.read("t").count() == 4 and v.generation() == 1 and (v.key("a"), v.key("b")) == (1, 2)
    assert v.prune() == 4 and v.read("t").count() == 4


def test_counts_merge(spark):
    df = lambda rows: spark.createDataFrame(rows, "term string, frequency bigint")
    got = index.merge_counts(df([("a", 2), ("b", 1)]), df([("c", 1)]), df([("b", 1), ("a", 1)])).collect()
    assert {(r.term, r.frequency) for r in got} == {("a", 1), ("c", 1)}


def test_mask_stays_above_the_ranking(spark):
    """The plan keeps the semi-join above the window, so ranks are of the whole corpus."""
    rows = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("note_id"), (-F.col("id")).cast("double").alias("score"))
    ranked = lexical.ranked(rows, 50)
    allowed = spark.createDataFrame([(99,), (96,), (93,)], "note_id bigint")
    assert sorted((r.note_id, r["rank"]) for r in fusion.masked(ranked, allowed).collect()) == [(93, 3), (96, 2), (99, 1)]
