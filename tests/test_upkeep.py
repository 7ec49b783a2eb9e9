import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import actions, changes, fuzzy, journal, manifests, vectors
from quern.operators.vector_store import VectorStore
from quern.operators.versions import Conflict, Versions
from quern.operators.writer import IndexWriter, UnsafePath
from quern.sources import files
from quern.sources import notes as sources

NOTE = "note_id bigint, fields array<struct<name:string,value:string>>, tags array<string>, decks array<string>, note_type string, card_ids array<bigint>, title string"


def notes(spark, rows):
    return spark.createDataFrame([(i, [("Front", f), ("Back", b)], ["#UWorld::1"], ["D"], "Basic", [c], None) for i, f, b, c in rows], NOTE)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "note_id bigint")


@pytest.fixture()
def writer(spark, tmp_path):
    w = IndexWriter(spark, str(tmp_path / "index"))
    w.rebuild(notes(spark, [(1, "alpha beta", "x", 11), (2, "beta gamma", "y", 12), (3, "delta", "z", 13)]), shards=2)
    return w


def words(w):
    return {r.term: r.frequency for r in w.versions.read("vocabulary").collect()}


def test_upsert_counts_and_generations(spark, writer):
    before = words(writer)
    assert before["beta"] == 2 and writer.versions.generation() == 1
    same = notes(spark, [(1, "alpha beta", "x", 11), (2, "beta gamma", "y", 99), (3, "delta", "z", 13)])
    assert writer.upsert(same) == (1, 2)  # another card only
    assert writer.versions.generation() == 1 and words(writer) == before
    assert {r.note_id: r.card_ids for r in writer.documents().collect()}[2] == [99]
    changed = notes(spark, [(2, "beta epsilon", "y", 99), (4, "new", "w", 14)])
    assert writer.upsert(changed, requested=ids(spark, 2, 4, 5)) == (2, 0)
    got = words(writer)
    assert "gamma" not in got and got["epsilon"] == 1 and got["new"] == 1 and got["basic"] == 4 and writer.versions.generation() == 2
    assert writer.versions.key("n_notes") == 4
    fresh = IndexWriter(spark, writer.versions.root + "-again")
    fresh.rebuild(notes(spark, [(1, "alpha beta", "x", 11), (2, "beta epsilon", "y", 99), (3, "delta", "z", 13), (4, "new", "w", 14)]), shards=2)
    for name in ("counts", "postings", "terms", "vocabulary", "field_names", "stats", "source_tags", "hashes"):
        rows = [sorted(map(str, w.versions.read(name).select(sorted(w.versions.read(name).columns)).collect())) for w in (writer, fresh)]
        assert rows[0] == rows[1], name
    assert writer.versions.key("mean_length") == pytest.approx(fresh.versions.key("mean_length"))
    assert writer.delete(ids(spark, 3)) == 1 and writer.delete(ids(spark, 3, 77)) == 0 and writer.versions.generation() == 3
    assert [r.note_id for r in writer.documents(limit=2).collect()] == [1, 2]


def test_a_stale_plan_is_a_conflict(spark, writer):
    new = notes(spark, [(1, "changed", "x", 11)])
    plan = writer.plan(new, ids(spark, 1))
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    writer.upsert(notes(spark, [(1, "first", "x", 11)]), ids(spark, 1))
    with pytest.raises(Conflict):
        writer.apply(new, plan)
    assert "first" in words(writer) and "changed" not in words(writer)


def test_a_failed_rebuild_changes_nothing(spark, writer):
    bad = notes(spark, [(1, "x", "y", 1)]).withColumn("note_id", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception):
        writer.rebuild(bad)
    assert writer.versions.generation() == 1 and words(writer)["beta"] == 2


def test_path_guard(spark, tmp_path):
    for name in ("collection.anki2", "x.anki21"):
        with pytest.raises(UnsafePath):
            IndexWriter(spark, str(tmp_path / name))
    (tmp_path / "file").write_text("x")
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "photo.jpg").write_text("x")
    for name in ("file", "full"):
        with pytest.raises(UnsafePath):
            IndexWriter(spark, str(tmp_path / name))
    (tmp_path / "empty").mkdir()
    IndexWriter(spark, str(tmp_path / "empty"))


def test_aliases_resource_and_archive(spark, writer, tmp_path):
    pairs = lambda rows: spark.createDataFrame(rows, "alias string, canonical string")
    assert writer.set_aliases(pairs([("Zyban", "Bupropion"), ("x", "X"), ("", "y")])) == 1 and writer.versions.generation() == 2
    assert writer.set_aliases(pairs([])) == 0 and writer.versions.generation() == 2
    path = tmp_path / "a.json.gz"
    path.write_bytes(gzip.compress(json.dumps({"aliases": [{"alias": "HCTZ", "canonical": "Hydrochlorothiazide"}]}).encode()))
    assert writer.load_aliases(str(path)) == 1 and writer.load_aliases(str(path)) == 0
    writer.rebuild(notes(spark, [(1, "alpha", "x", 11)]), shards=2)
    assert {(r.alias, r.source) for r in writer.aliases().collect()} == {("zyban", "user"), ("hctz", "release")}
    assert writer.archive_other_schema() is None
    writer.versions.publish({}, False, {"schema": 1})
    aside = writer.archive_other_schema()
    assert Versions(spark, aside).read("prepared").count() == 1 and not writer.versions.has("prepared")
    assert writer.aliases().count() == 2
    stats = writer.stats().first()
    assert (stats.note_count, stats.alias_count, stats.schema_version) == (0, 2, 2) and stats.index_bytes > 0


def test_backfills(spark, writer):
    assert not writer.backfill_tags() and not writer.backfill_hashes()
    writer.versions.publish({"source_tags": writer.versions.read("source_tags").where("false")}, False)
    assert writer.backfill_tags(revision=9) and writer.versions.read("source_tags").count() == 3 and not writer.backfill_tags(revision=9)
    before = sorted(map(str, writer.versions.read("hashes").collect()))
    writer.versions.publish({}, False, drop=("hashes",))
    assert writer.backfill_hashes() and sorted(map(str, writer.versions.read("hashes").collect())) == before
    writer.replace_tags(notes(spark, [(1, "a", "b", 1)]).withColumn("tags", F.array(F.lit("#AMBOSS::9"))))
    assert {r.tag_key for r in writer.versions.read("source_tags").where("note_id = 1").collect()} == {"#amboss::9"}
    assert writer.versions.generation() == 1


def test_journal_keys_queue_and_audits(spark, tmp_path):
    j = journal.Journal(Versions(spark, str(tmp_path / "j")))
    assert j.work() == {"pending": False, "audit": False} and j.get("x") is None and not j.delete("x")
    j.set("x", "1")
    assert j.get("x") == "1" and j.delete("x") and j.get("x") is None
    first = j.enqueue(ids(spark, 1, 2, 2, -5), changes.LEXICAL)
    second = j.enqueue(ids(spark, 2, 3), changes.SEMANTIC)
    assert second == first + 1
    assert [(r.note_id, r.reasons, r.sequence) for r in j.pending().collect()] == [(1, 1, first), (2, 3, second), (3, 2, second)]
    j.mark_attempted(spark.createDataFrame([(2, second), (1, 99)], "note_id bigint, sequence bigint"))
    assert {r.note_id: r.attempts for r in j.queue().collect()} == {1: 0, 2: 1, 3: 0}
    stale = spark.createDataFrame([(1, first), (2, first)], "note_id bigint, sequence bigint")
    assert not j.acknowledge_all(stale) and j.pending_count() == 3
    j.acknowledge(spark.createDataFrame([(2, second, 1), (1, 99, None)], "note_id bigint, sequence bigint, reasons int"))
    assert {r.note_id: r.reasons for r in j.queue().collect()} == {1: 1, 2: 2, 3: 2}
    assert j.acknowledge_all(j.queue().select("note_id", "sequence")) and not j.has_pending()
    old = j.request_audit("one")
    new = j.request_audit("two")
    j.set("force_hydration", "1")
    assert not j.complete_audit(old, ("force_hydration",)) and j.audit_request()["reason"] == "two" and j.get("force_hydration") == "1"
    assert j.complete_audit(new, ("force_hydration",)) and j.audit_request() is None and j.get("force_hydration") is None
    assert j.work() == {"pending": False, "audit": False}


def test_manifest_rows_are_checked(spark, tmp_path):
    j = journal.Journal(Versions(spark, str(tmp_path / "j")))
    cards = lambda rows: spark.createDataFrame(rows, manifests.CARD_MANIFEST)
    for bad in ([(0, 1, 1)], [(1, -1, 1)], [(1, 1, None)]):
        with pytest.raises(Exception, match="positive"):
            j.replace_manifest("card_manifest", cards(bad))
    with pytest.raises(Exception, match="facet"):
        j.replace_manifest("facet_manifest", spark.createDataFrame([(" ", 1, "x")], manifests.FACET_MANIFEST))
    j.replace_manifest("card_manifest", cards([(1, 10, 5), (2, 10, 5), (3, 11, 5)]))
    with pytest.raises(Exception, match="belongs to none"):
        j.replace_cards_of(ids(spark, 10), cards([(9, 11, 5)]))
    assert j.manifest("card_manifest").count() == 3  # nothing of a refused change is kept
    j.replace_cards_of(ids(spark, 10), cards([(2, 10, 6)]))
    assert {tuple(r) for r in j.manifest("card_manifest").collect()} == {(2, 10, 6), (3, 11, 5)}
    j.delete_manifest("card_manifest", ids(spark, 11))
    assert {tuple(r) for r in j.manifest("card_manifest").collect()} == {(2, 10, 6)}
    with pytest.raises(ValueError):
        manifests.page(cards([]), "card_id", limit=0)


def test_fingerprint_waits_for_the_queue(spark, writer, tmp_path):
    j = journal.Journal(Versions(spark, str(tmp_path / "j")))
    j.set("pending_fingerprint", "new")
    j.enqueue(ids(spark, 1), 1)
    assert not j.promote_fingerprint(writer) and writer.fingerprint() is None
    j.acknowledge_all(j.queue().select("note_id", "sequence"))
    j.request_audit()
    assert not j.promote_fingerprint(writer)
    j.complete_audit(j.audit_request()["sequence"])
    assert j.promote_fingerprint(writer) and writer.fingerprint() == "new" and j.get("pending_fingerprint") is None
    assert not j.promote_fingerprint(writer)


def test_vocabulary_serves_until_the_new_one_is_ready(spark):
    made = []

    def load():
        if len(made) == 1:
            made.append(None)
            raise RuntimeError("not now")
        made.append(spark.range(len(made) + 1))
        return made[-1]

    v = journal.Vocabulary(load)
    one = v.use(1)
    assert v.use(2) is one and v.is_stale(2)
    with pytest.raises(RuntimeError):
        v.use(2, refresh=True)
    assert v.use(2) is one
    assert v.use(2, refresh=True) is not one and not v.is_stale(2)


def test_vectors(spark, tmp_path):
    s = "note_id bigint, content_hash string, embedding array<double>"
    store = VectorStore(spark, str(tmp_path / "v"), 3)
    model = lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts]
    assert store.status()["state"] == "empty" and store.search(["x"], model)[1] == "empty"
    for bad in ([1.0, 2.0], [0.0, 0.0, 0.0]):
        with pytest.raises(ValueError):
            store.upsert(spark.createDataFrame([(1, "h", bad)], s))
    assert store.count() == 0
    store.upsert(spark.createDataFrame([(1, "a", [3.0, 0.0, 0.0]), (2, "b", [0.0, 2.0, 0.0]), (3, "c", [1.0, 1.0, 0.0])], s))
    assert store.problems().count() == 0 and store.status()["state"] == "incomplete"
    store.mark(5)
    assert store.status(5)["state"] == "ready" and store.status(6)["state"] == "incomplete"
    assert store.delete(ids(spark, 77)) == 0 and store.source_generation() == 5  # nothing changed
    assert store.remove(ids(spark, 2)) == (1, "ready") and store.source_generation() is None
    assert {r.note_id for r in store.known_hashes().collect()} == {1, 3} and store.known_hashes(ids(spark)).count() == 0
    hits, state = store.search(["", "y"], lambda t: [[0.0, 5.0, 0.0]], limit=1, allowed=ids(spark, 1, 3))
    assert state == "ready" and [(r.query_id, r.note_id, r.rank) for r in hits.collect()] == [(1, 3, 1)]
    assert store.search(["y"], lambda t: 1 / 0)[1] == "unavailable"
    docs = spark.createDataFrame([(1, "text one", "t"), (4, "", "title"), (5, " ", " ")], "note_id bigint, plain_text string, title string")
    assert store.index_documents(docs, model, generation=8) == 2 and store.index_documents(docs, model, generation=9) == 0
    assert {r.note_id for r in store.known_hashes().collect()} == {1, 4} and store.status(9)["state"] == "ready"
    work = spark.createDataFrame([(1, "delete"), (4, "upsert")], "note_id bigint, action string")
    assert store.apply_batch(work, docs.withColumn("plain_text", F.lit("new text")), model) == {"deleted": 1, "embedded": 1}


def test_batch_topk_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(400, None), (401, [1.0, 2.0]), (402, [0.0] * 4)]
    v = spark.createDataFrame(rows, "note_id bigint, embedding array<double>").repartition(5)
    q = v.where("note_id < 60").select(F.col("note_id").alias("query_id"), "embedding")
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and len(x) == 4 and any(x)}
    want = {}
    for i in unit:
        if i < 60:
            want[i] = [n for n, _ in sorted(((n, round(float(u @ unit[i]), 12)) for n, u in unit.items()), key=lambda x: (-x[1], x[0]))[:7]]
    for block in (1024, 16):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        got = {}
        for r in vectors.topk_batch(v, q, 7).withColumn("similarity", F.round("similarity", 12)).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.note_id))
        assert {i: len(x) for i, x in got.items()} == dict.fromkeys(want, 7)
        best = {i: sorted(round(float(unit[n] @ unit[i]), 9) for _, n in x) for i, x in got.items()}
        assert best == {i: sorted(round(float(unit[n] @ unit[i]), 9) for n in x) for i, x in want.items()}
    assert vectors.topk_batch(v, q.where("false"), 7).count() == 0


def test_embedding_is_cut_and_of_length_one(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (2, "a")], "note_id bigint, text string")
    model = lambda ts: [[float(t.count(" ")), 3.0] for t in ts]
    got = {r.note_id: r.embedding for r in vectors.embed(texts, model, tokens=lambda t: [x + " " for x in t.split()], most_tokens=2).collect()}
    assert got[1] == pytest.approx([2 / 13**0.5, 3 / 13**0.5]) and got[2] == pytest.approx([1 / 10**0.5, 3 / 10**0.5])


def test_releases(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("d/RxIngredients1.txt", "﻿RXCUI|INGREDIENT\r\n1|Bupropion\r\n2|Hydrochlorothiazide\r\n2|Losartan\r\n3|Hydrochlorothiazide\r\n")
        z.writestr("d/RxTerms1.txt", "RXCUI|BRAND_NAME|DISPLAY_NAME|DISPLAY_NAME_SYNONYM|SUPPRESS_FOR|IS_RETIRED\r\n1|Zyban|buPROPion (Oral Pill)|bup;| |\r\n2|Hyzaar||HCTZ|| \r\n3|||HCTZ; 12||\r\n1|Gone|||x|\r\n1|Old||||2020\r\n9|NoIngredient||||\r\n")
        z.writestr("d/readme.md", "no")
    read = lambda prefix: files.read_zipped(spark, str(tmp_path / "r.zip"), prefix)
    products, spellings = files.release_products(read("RxTerms"), read("RxIngredients"))
    assert spellings.columns == ["ingredient", "surface"]
    got = {(r.alias, r.surface, r.ingredient) for r in fuzzy.shared_ingredients(products).collect()}
    assert got == {("zyban", "Zyban", "bupropion"), ("bup", "bup", "bupropion"), ("hyzaar", "Hyzaar", "hydrochlorothiazide"), ("hyzaar", "Hyzaar", "losartan"), ("hctz", "HCTZ", "hydrochlorothiazide")}
    with pytest.raises(Exception, match="one Rx file"):
        read("Rx").count()


def test_release_names_keep_accents(spark):
    df = spark.createDataFrame([("  CafÉ  Ａb ",), ("STRASSE",), (None,), ("Straße",)], "n string")
    assert [r[0] for r in df.select(T.release_name(F.col("n"))).collect()] == ["café ab", "strasse", None, "strasse"]


def test_titles_decks_selection_and_guards(spark):
    rows = [(1, [("a", "<br>"), ("b", "{{c1::x::hint}} y")], [], [], "", [1], None), (2, [("a", " ")], [], [], "", [1], None)]
    got = sources.legacy_titles(spark.createDataFrame(rows, NOTE))
    assert {r.note_id: r.title for r in got.collect()} == {1: "x y", 2: ""}
    catalog = spark.createDataFrame([(5, "F", True), (7, "B", False), (6, "A", False)], "id bigint, name string, filtered boolean")
    assert sources.current_deck(catalog, None, 99, 5) == 5 and sources.current_deck(catalog, 99) == 6
    assert sources.current_deck(catalog.where("filtered")) == 5 and sources.current_deck(catalog.where("false"), 1) is None
    s = "position int, note_id bigint, card_ids array<bigint>, card_states string, sibling_count int, title string"
    shown = spark.createDataFrame([(1, 10, [1], "old", 1, "t"), (2, 11, [2, 3], "old", 2, "u")], s)
    fresh = spark.createDataFrame([(2, 11, [2, 3], "new", 5, "ignored"), (1, 10, [1], "new", 4, "ignored")], s)
    assert {(r.note_id, r.card_states, r.sibling_count, r.title) for r in actions.refreshed(shown, fresh).collect()} == {(10, "new", 4, "t"), (11, "new", 5, "u")}
    assert actions.refreshed(shown, fresh.where("position = 1")) is None
    assert actions.refreshed(shown, fresh.withColumn("card_ids", F.reverse("card_ids"))) is None
    df = spark.createDataFrame([(None, [(0, 2)]), ("a<b", [(0, 1)])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(T.snippet_html(F.col("t"), F.col("s"))).collect()] == ["", "<b>a</b>&lt;b"]
