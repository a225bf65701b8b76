import datetime as dt

import pytest
from helpers import at, catalog, rows
from pyspark.sql import Row
from test_saved import events, keys, random_steps, replay

from stackroom.operators.reconcile import backfill
from stackroom.schemas import CATALOG, OBJECTS, SAVED_EVENTS
from stackroom.sources.objects import stream_objects
from stackroom.streaming.backfill import backfill_stream
from stackroom.streaming.saved_state import Membership, members, saved_state_stream

AS_OF = dt.datetime(2024, 6, 1)


def run_steps(spark, tmp_path, steps, **options):
    """One more file of steps, and a run that takes it in."""
    source, checkpoint = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    events(spark, steps).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SAVED_EVENTS).parquet(source)
    query = saved_state_stream(stream, checkpoint, **options)
    query.awaitTermination()
    return query


def state(spark, tmp_path):
    return rows(members(spark, str(tmp_path / "checkpoint")))


def test_saved_state_over_several_runs_equals_a_replay(spark, tmp_path):
    """Each run is a restart from the checkpoint of the one before."""
    steps = sorted(random_steps(300, 7), key=lambda step: (step[3], step[4]))
    for part in range(4):
        run_steps(spark, tmp_path, steps[part * 75 : part * 75 + 75])
        assert state(spark, tmp_path) == replay(steps[: part * 75 + 75])


@pytest.mark.parametrize("seed", [8, 9])
def test_late_steps_take_their_place(spark, tmp_path, seed):
    """Steps in any order over batches, within the delay: the result is that of the whole order."""
    steps = random_steps(160, seed)
    for part in range(4):
        run_steps(spark, tmp_path, steps[part * 40 : part * 40 + 40], delay="1 hour")
        assert state(spark, tmp_path) == replay(steps[: part * 40 + 40])


def test_what_the_watermark_has_passed_is_settled(spark, tmp_path):
    """Later than the delay, a step is dropped; state keeps one short row for a key."""
    early = [(1, "a", "put", 0, 0), (1, "a", "toggle", 1, 1), (1, "b", "toggle", 2, 2), (1, "c", "put", 3, 3), (1, "c", "toggle", 3, 4)]
    run_steps(spark, tmp_path, early, delay="10 seconds")
    assert state(spark, tmp_path) == [(1, "b")]
    run_steps(spark, tmp_path, [(2, "z", "put", 1000, 5)], delay="10 seconds")
    run_steps(spark, tmp_path, [(1, "a", "put", 500, 6), (1, "b", "toggle", 1001, 7), (1, "c", "toggle", 1002, 8)], delay="10 seconds")
    assert state(spark, tmp_path) == [(1, "c"), (2, "z")]
    stored = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "member").load()
    found = {tuple(r.key): r.value for r in stored.collect()}
    assert (1, "a") not in found and len(found[1, "c"].toggles) == 1 and found[1, "c"].settled is False


def test_a_batch_that_runs_again_gives_the_same_members(spark, tmp_path):
    """A lost commit makes the stream hand over its last batch once more."""
    steps = random_steps(80, 8)
    run_steps(spark, tmp_path, steps)
    for _ in range(2):
        marks = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda mark: int(mark.name))
        for mark in (marks[-1], marks[-1].with_name(f".{marks[-1].name}.crc")):
            mark.unlink()
        run_steps(spark, tmp_path, [])
        assert state(spark, tmp_path) == replay(steps)


def test_members_from_before_the_stream(spark, tmp_path):
    before = keys(spark, (1, "a"), (1, "b"), (2, "c"), (2, "c"))
    steps = [(1, "a", "toggle", 0, 0), (1, "b", "put", 0, 1), (3, "d", "toggle", 0, 2)]
    run_steps(spark, tmp_path, steps, initial=before)
    assert state(spark, tmp_path) == [(1, "b"), (2, "c"), (3, "d")] == replay(steps, [(1, "a"), (1, "b"), (2, "c")])


def test_steps_of_a_hot_key_are_thinned_before_the_shuffle(spark, tmp_path):
    steps = [(1, "hot", "toggle" if i % 100 else "put", i, i) for i in range(2000)] + [(2, "x", "toggle", 5, 2000), (None, "x", "put", 1, 1)]
    query = run_steps(spark, tmp_path, steps)
    assert state(spark, tmp_path) == sorted(replay([s for s in steps if s[0] is not None]))
    report = next(p for p in query.recentProgress if p.numInputRows)
    assert report.stateOperators[0].numRowsUpdated <= 2


def test_a_key_s_steps_are_folded_as_plain_rows():
    """A pandas frame for each key, in and out, took most of the time."""
    kept = {}

    class Value:
        get = lambda self: kept.get("member")
        update = lambda self, value: kept.update(member=value)
        clear = lambda self: kept.pop("member", None)

    class Handle:
        timers = []
        getValueState = lambda self, name, schema: Value()
        registerTimer = lambda self, at: self.timers.append(at)

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    member = Membership()
    member.init(Handle())
    fold = lambda *steps: list(member.handleInputRows((1, "a"), (Row(at=at, seq=seq, op=op) for at, seq, op in steps), Times()))
    assert fold((9000, 3, "toggle"), (5000, 1, "put")) == [Row(user_id=1, id="a", saved=False)]
    assert kept["member"] == (False, 5000, 1, True, [(9000, 3)]) and Handle.timers == [10]
    assert fold((7000, 2, "delete"), (5000, 0, "toggle")) == [Row(user_id=1, id="a", saved=True)]
    assert kept["member"] == (False, 7000, 2, False, [(9000, 3)])


def test_a_name_in_three_batches_is_registered_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / name) for name in ("listing", "rows", "checkpoint"))
    known = catalog(spark, {"id": "k", "gcs_path": "uploads/known"}, {"id": "n"})
    listing = [
        ["uploads/1-a.pdf", "uploads/2-b.pdf", "uploads/"],
        ["uploads/2-b.pdf", "uploads/3-c.pdf", "uploads/known"],
        ["uploads/2-b.pdf", "uploads/1-a.pdf"],
    ]
    counts = []
    for names in listing:
        spark.createDataFrame([(n,) for n in names], OBJECTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OBJECTS).parquet(source)
        query = backfill_stream(stream, known, path, checkpoint, AS_OF)
        query.awaitTermination()
        counts.append(sum(p.observedMetrics["backfill"].processed for p in query.recentProgress if "backfill" in p.observedMetrics))
    assert counts == [2, 1, 0]
    new = spark.read.schema(CATALOG).parquet(path)
    assert rows(new) == rows(backfill(spark.read.parquet(source).distinct(), known, AS_OF))
    assert new.count() == 3


def test_a_registering_batch_that_runs_again_counts_once(spark, tmp_path):
    source, path, checkpoint = tmp_path / "listing", str(tmp_path / "rows"), tmp_path / "checkpoint"
    spark.createDataFrame([("uploads/1-a.pdf",), ("uploads/2-b.pdf",)], OBJECTS).write.parquet(str(source))
    for _ in range(3):
        stream = spark.readStream.schema(OBJECTS).parquet(str(source))
        backfill_stream(stream, catalog(spark), path, str(checkpoint), AS_OF).awaitTermination()
        assert rows(spark.read.schema(CATALOG).parquet(path), "title") == [("a",), ("b",)]
        for mark in (checkpoint / "commits").iterdir():
            mark.unlink()


def test_backfill_of_arriving_files(spark, tmp_path):
    root, path = tmp_path / "bucket", str(tmp_path / "rows")
    (root / "uploads").mkdir(parents=True)
    for name in ("5-a.pdf", "b.pdf"):
        (root / "uploads" / name).write_bytes(b"x")
        stream = stream_objects(spark, str(root))
        backfill_stream(stream, catalog(spark), path, str(tmp_path / "checkpoint"), AS_OF).awaitTermination()
    new = spark.read.schema(CATALOG).parquet(path)
    assert rows(new, "title") == [("a",), ("b",)]
    assert new.where("title = 'b'").first().created_at == AS_OF and at() < AS_OF
