import time

import pytest
from pyspark.sql import functions as F

from quern.operators import actions, changes, related, vectors
from quern.operators.versions import Versions
from quern.sources import files
from quern.sources import notes as sources
from quern.streaming import changes as streaming

FEED = "note_id bigint, reasons int, sequence bigint, queued_at double"


def test_note_diff(spark):
    s = "note_id bigint, a int, d binary"
    saved = spark.createDataFrame([(1, 1, b"x"), (2, 1, b"x"), (3, 1, b"x"), (5, 1, None)], s)
    current = spark.createDataFrame([(1, 1, b"x"), (2, 2, b"x"), (4, 1, b"x"), (5, 1, None)], s)
    got = {r.note_id: r.change for r in changes.note_diff(current, saved, ("a", "d"), ("d",)).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "deleted", 4: "added", 5: "changed"}


def test_moved_card_affects_both_owners(spark):
    s = "card_id bigint, note_id bigint, home_deck_id bigint"
    got = changes.card_diff(spark.createDataFrame([(1, 20, 5), (2, 30, 5)], s), spark.createDataFrame([(1, 10, 5), (2, 30, 5)], s))
    assert sorted(r.note_id for r in changes.affected_owners(got).collect()) == [10, 20]


def test_queue(spark):
    q = changes.coalesce_queue(spark.createDataFrame([(1, 1, 1, 1.0), (1, 4, 3, 3.0), (2, 16, 2, 2.0), (-1, 1, 4, 4.0)], FEED))
    assert sorted(tuple(r) for r in q.collect()) == [(1, 5, 3, 3.0, 0), (2, 16, 2, 2.0, 0)]
    assert [r.note_id for r in changes.pending(q).collect()] == [2, 1]
    tried = changes.attempted(q, spark.createDataFrame([(1, 3), (2, 1)], "note_id bigint, sequence bigint"))
    assert {r.note_id: r.attempts for r in tried.collect()} == {1: 1, 2: 0}
    merged = changes.coalesce_queue(spark.createDataFrame([(2, 1, 9, 9.0)], FEED), tried)
    assert {r.note_id: (r.reasons, r.attempts) for r in merged.collect()} == {1: (5, 1), 2: (17, 0)}
    acks = spark.createDataFrame([(1, 3, 1), (2, 1, None)], "note_id bigint, sequence bigint, reasons int")
    assert {r.note_id: r.reasons for r in changes.acknowledge(q, acks).collect()} == {1: 4, 2: 16}  # the stale one changes nothing
    gone = changes.acknowledge(q, spark.createDataFrame([(1, 3, None), (2, 2, 16)], "note_id bigint, sequence bigint, reasons int"))
    assert gone.count() == 0
    assert not changes.acknowledge_all(q, spark.createDataFrame([(1, 3), (2, 1)], "note_id bigint, sequence bigint"))[1]
    left, done = changes.acknowledge_all(q, spark.createDataFrame([(1, 3)], "note_id bigint, sequence bigint"))
    assert done and [r.note_id for r in left.collect()] == [2]


def test_last_wins(spark):
    rows = [(1, 1, True), (1, 2, False), (2, 5, False), (2, 5, True)]
    got = changes.last_wins(spark.createDataFrame(rows, "note_id bigint, sequence bigint, deleted boolean")).collect()
    assert {(r.note_id, r.action) for r in got} == {(1, "upsert"), (2, "delete")}


def test_fingerprint(spark):
    df = spark.range(5)
    one = changes.fingerprint(t=(df, {"n": F.count("*"), "s": F.sum("id")}))
    assert one != changes.fingerprint(t=(df.where("id > 0"), {"n": F.count("*"), "s": F.sum("id")}))


def test_queue_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    spark.createDataFrame([(1, 1, 1, 1.0), (1, 2, 2, 2.0)], FEED).write.parquet(str(feed / "a"))
    v = Versions(spark, str(tmp_path / "queue"))
    read = lambda: spark.readStream.schema(FEED).option("recursiveFileLookup", True).parquet(str(feed))
    streaming.queue_stream(read(), v, str(tmp_path / "cp")).awaitTermination()
    time.sleep(0.1)
    spark.createDataFrame([(1, 8, 3, 3.0), (2, 1, 4, 4.0)], FEED).write.parquet(str(feed / "b"))
    streaming.queue_stream(read(), v, str(tmp_path / "cp")).awaitTermination()
    assert {(r.note_id, r.reasons, r.sequence) for r in v.read("queue").collect()} == {(1, 11, 3), (2, 1, 4)}
    # what others commit under this root makes no batch look done, and a batch runs once only
    for _ in range(3):
        v.publish({}, keys={"other": 1})
    spark.createDataFrame([(3, 1, 5, 5.0)], FEED).write.parquet(str(feed / "c"))
    streaming.queue_stream(read(), v, str(tmp_path / "cp")).awaitTermination()
    assert {r.note_id for r in v.read("queue").collect()} == {1, 2, 3} and v.key("batch:queue") == 2
    again = spark.createDataFrame([(9, 1, 9, 9.0)], FEED)
    assert v.key("batch:queue") >= 2 and again.count() == 1


def test_running_state_and_late_events(spark, tmp_path):
    feed = tmp_path / "events"
    schema = "event_id bigint, note_id bigint, sequence bigint, reasons int, event_type string, ts timestamp"
    stamp = lambda h: f"2024-01-01 {h:02d}:00:00"
    one = [(1, 7, 5, 1, "a", stamp(1)), (1, 7, 5, 1, "a", stamp(1)), (2, 7, 3, 4, "a", stamp(2)), (3, 8, 1, 2, "b", stamp(9))]
    spark.createDataFrame(one, "event_id bigint, note_id bigint, sequence bigint, reasons int, event_type string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(feed))
    read = lambda: spark.readStream.schema(schema).parquet(str(feed))

    def run(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    state = run(streaming.running_state(read()), "complete", "running")
    assert {(r.note_id, r.sequence, r.reasons) for r in state} == {(7, 5, 5), (8, 1, 2)}
    assert sorted(r.event_id for r in run(streaming.late_guard(read()), "append", "guarded")) == [1, 2, 3]
    spans = run(streaming.windowed_counts(read()), "append", "spans")
    assert {(r.event_type, r.events) for r in spans} >= {("a", 2), ("a", 1)}
    assert streaming.debounce() == {"processingTime": "1200 milliseconds"} and streaming.debounce(99) == {"processingTime": "10000 milliseconds"}


def test_related_tags(spark):
    rows = [
        (1, ["#AK_Step2_v12::#UWorld::18462", "broad::#UWorld"]), (2, ["#ak_step2_v12::#uworld::18462", "x"]), (3, ["#AK_Step2_v12::#UWorld::184620"]),
        (4, ["#AK_Step2_v11::#UWorld::18462"]), (5, ["myuworldish::1"]), (6, ["a::AMBOSS::z", "#AK_Step2_v12::#UWorld::18462"]),
    ]
    tags = related.source_tags(spark.createDataFrame(rows, "note_id bigint, tags array<string>"))
    assert {r.note_id for r in tags.collect()} == {1, 2, 3, 4, 6}
    got = related.best(related.related(tags, spark.createDataFrame([(1,)], "note_id bigint")), 10).collect()
    assert [(r.note_id, r.shared, r.least, r.total) for r in got] == [(2, 1, 3, 3), (6, 1, 3, 3)]
    assert got[0].score == pytest.approx(1 + 1 / 3)
    label = tags.where("note_id = 1").select(related.reason(F.col("provider"), F.col("leaf")).alias("r")).first().r
    assert label == "Related · UWorld · 18462"


def test_vectors(spark):
    s = "note_id bigint, embedding array<float>"
    df = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (20, [0.9, 0.1, 0.0]), (30, [0.0, 1.0, 0.0])], s)
    assert [r.note_id for r in vectors.topk(df, [1.0, 0.0, 0.0], 2).collect()] == [10, 20]
    assert vectors.topk(df, [0.0, 0.0, 0.0], 2).count() == 0
    assert [r.note_id for r in vectors.topk(df, [1.0, 0.0, 0.0], 2, spark.createDataFrame([(30,)], "note_id bigint")).collect()] == [30]
    same = spark.range(1, 4101).select(F.col("id").alias("note_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    assert [r.note_id for r in vectors.topk(same, [1.0, 1.0], 3).collect()] == [1, 2, 3]
    batch = vectors.topk_batch(same, spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "query_id bigint, embedding array<float>"), 3)
    assert sorted((r.query_id, r.note_id, r["rank"]) for r in batch.collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    with pytest.raises(ValueError):
        vectors.upsert(df, spark.createDataFrame([(1, [0.0, 0.0, 0.0])], s), 3)
    merged = vectors.upsert(df, spark.createDataFrame([(10, [0.0, 2.0, 0.0])], s), 3)
    assert [round(x, 6) for x in merged.where("note_id = 10").first().embedding] == [0, 1, 0]
    model = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert [list(r.embedding) for r in vectors.embed(spark.createDataFrame([(1, "abc")], "note_id bigint, text string"), model).collect()] == [pytest.approx([3 / 10**0.5, 1 / 10**0.5])]


def test_actions(spark):
    cards = spark.createDataFrame([(1, 10, 0, False, False, 5), (2, 10, 3, True, False, 5), (3, 11, 0, False, True, 6)], "card_id bigint, note_id bigint, flag int, suspended boolean, buried boolean, home_deck_id bigint")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (-1,)], "card_id bigint")
    want = {"flag": (4, 3, 2, 1, 1, 2), "suspend": (4, 3, 2, 1, 1, 2), "unsuspend": (4, 3, 1, 1, 2, 1), "bury": (4, 3, 1, 1, 2, 1), "unbury": (4, 3, 1, 1, 2, 1), "change_deck": (4, 3, 1, 1, 2, 1)}
    for kind, counts in want.items():
        a = actions.Action(kind, flag=3, deck_id=5)
        assert tuple(actions.counts(actions.classify(asked, cards, a)).first()) == counts, kind
    with pytest.raises(ValueError):
        actions.Action("flag", flag=9)
    with pytest.raises(ValueError):
        actions.Action("add_tags")
    text = actions.state_counts(cards, "note_id").select("note_id", actions.state_summary().alias("s")).collect()
    assert {r.note_id: r.s for r in text} == {10: "1 of 2 cards suspended. Flags: green 1, unflagged 1.", 11: "1 of 1 card buried."}
    assert actions.clamp_limit(5) == 10 and actions.clamp_limit("x") == 50


def test_snapshot(spark):
    notes = spark.createDataFrame([(1, "g", 7, 100, " a b  a ", "Front\x1fBack\x1fmore"), (-2, "h", 7, 1, "", "x")], "id bigint, guid string, mid bigint, mod bigint, tags string, flds string")
    cards = spark.createDataFrame([(12, 1, 3, 2), (11, 1, 2, 0)], "id bigint, nid bigint, did bigint, odid bigint")
    decks = spark.createDataFrame([(2, "D::e"), (3, "Filtered")], "id bigint, name string")
    models = spark.createDataFrame([(7, "Basic", ["F", "B"])], "id bigint, name string, field_names array<string>")
    r = sources.snapshot(notes, cards, decks, models).collect()
    assert len(r) == 1 and r[0].card_ids == [11, 12] and r[0].decks == ["D::e"] and r[0].tags == ["a", "b"] and r[0].note_type == "Basic"
    assert [tuple(f) for f in r[0].fields] == [("F", "Front"), ("B", "Back"), ("Field 3", "more")] and r[0].title == "Front"
    assert {(d.id, d.filtered) for d in sources.deck_catalog(decks, decks.where("id = 2")).collect()} == {(2, False), (3, True)}
    with pytest.raises(ValueError):
        sources.bounded(list(range(1, 300)))


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"aliases": [{"alias": "Zyban", "canonical": "Bupropion"}, {"alias": "x", "canonical": "X"}, {"alias": "q", "alias_norm": "plan b", "canonical": "c"}]}')
    got = files.read_aliases(spark, str(tmp_path / "a.json"))
    assert {tuple(r) for r in got.collect()} == {("zyban", "bupropion"), ("plan b", "c")}
    (tmp_path / "t.tsv").write_text("#separator:tab\nfront\tback\ttag\n")
    assert [tuple(r) for r in files.read_tabbed(spark, str(tmp_path / "t.tsv")).collect()] == [("front", "back", "tag")]
    (tmp_path / "p.txt").write_text("A|B\n1|2\n")
    assert files.read_piped(spark, str(tmp_path / "p.txt")).first().B == "2"
