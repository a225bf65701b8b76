"""The object store: listing by key ranges, putting in two steps."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stackroom.functions.naming import UPLOAD_PREFIX
from stackroom.operators import browse
from stackroom.sources import store as S

ODD = [
    "uploads/", "uploads/1-a.pdf", "uploads/1-uploads/y.pdf", "uploads/_draft.pdf", "uploads/.pdf", "uploads/n._COPYING_", "uploads/a b%c+.pdf",
    "uploads/../x", "uploads//y", "uploads/./z", "other/z.pdf", "uploads/\u00e9\U0001f600.pdf", "%", "uploads/1-a.pdf%2F", "uploadsx/a", ".staged/a",
]


def put(spark, root, keys, content=b"x"):
    frame = spark.createDataFrame([(k, content + k.encode(), f"type of {k}") for k in keys], "name string, content binary, kind string")
    return S.put_objects(frame.repartition(4), str(root))


def test_every_name_comes_out_as_it_went_in(spark, tmp_path):
    about = put(spark, tmp_path / "store", ODD)
    assert rows(about, "name", "kind") == sorted(((k, f"type of {k}") for k in ODD), key=repr)
    listed = S.list_objects(spark, str(tmp_path / "store"), content=True)
    assert rows(listed, "name", "content") == sorted(((k, b"x" + k.encode()) for k in ODD), key=repr)
    assert (tmp_path / "store" / "uploads" / "1-a.pdf").read_bytes() == b"xuploads/1-a.pdf"
    assert {r.size for r in listed.where("name = '%'").collect()} == {2}


def test_a_listing_is_cut_into_ranges_and_narrowed_by_the_query(spark, tmp_path):
    names = [f"uploads/{1704067200000 + i * 977}-{i}.pdf" for i in range(3000)] + [f"other/{i}" for i in range(50)]
    folder = tmp_path / "store"
    for name in names:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.touch()
    listed = S.list_objects(spark, str(folder), ranges=32)
    assert sorted(r.name for r in listed.collect()) == sorted(names)
    uploads = listed.where(F.startswith("name", F.lit(UPLOAD_PREFIX)))
    counts = uploads.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in counts) == 3000 and len(counts) >= 20 and max(r["count"] for r in counts) < 600
    reader = S.ListingReader({"path": str(folder)})
    assert not list(reader.pushFilters([S.StringStartsWith(("name",), UPLOAD_PREFIX)]))
    ranges = reader.partitions()
    assert ranges[0].after == UPLOAD_PREFIX and ranges[-1].upto == "uploads0"
    for condition, wanted in (
        (F.col("name") == names[7], [names[7]]),
        ((F.col("name") > names[10]) & (F.col("name") < names[13]), names[11:13]),
        (F.col("name") >= "uploads/1704070", [n for n in names if n >= "uploads/1704070"]),
    ):
        assert sorted(r.name for r in listed.where(condition).collect()) == sorted(wanted)
    assert "uploads/" in browse.object_listing(listed)._jdf.queryExecution().executedPlan().toString()


def test_ranges_cover_all_keys_of_random_stores(tmp_path):
    draw = random.Random(3)
    for round_ in range(12):
        root = tmp_path / str(round_)
        keys = {"".join(draw.choice("ab/\u00e9.%") for _ in range(draw.randint(1, 7))) for _ in range(60)}
        # on file systems an object is not a folder as well
        keys = {k for k in keys if not any(o != k and o.startswith(k + "/") for o in keys)}
        store = S.Store(str(root))
        for n, key in enumerate(sorted(keys)):
            store.publish(store.stage("s", n, b""), key)
        store = S.Store(str(root))
        assert [e.key for e in store.entries()] == sorted(keys)
        for prefix in ("", "a", "a/", "\u00e9"):
            reader = S.ListingReader({"path": str(root), "ranges": "8"})
            list(reader.pushFilters([S.StringStartsWith(("name",), prefix)] if prefix else []))
            found = [n for p in reader.partitions() for batch in reader.read(p) for n in batch.column(0).to_pylist()]
            assert found == sorted(k for k in keys if k.startswith(prefix))


def test_neither_driver_nor_task_holds_a_whole_folder(tmp_path):
    """Each held every entry of a flat folder, with what the file system says of it."""
    (tmp_path / "uploads").mkdir()
    names = {f"uploads/{i:05}" for i in range(6000)}
    for name in names:
        (tmp_path / name).touch()
    outline = S.Outline(str(tmp_path), "uploads/", most=500)
    at = S.cuts(outline, "uploads/", 16)
    assert 8 <= len(at) <= 16 and sum(len(found) for found in outline._seen.values()) <= 501
    store, held = S.Store(str(tmp_path)), []
    within = store._within
    store._within = lambda *of: iter(held.append(found := list(within(*of))) or found)
    found = []
    for after, upto in zip(["", *at], [*at, None]):
        held.clear()
        part = [entry.key for entry in store.entries(after, upto)]
        assert len(part) < 1500 and sum(len(h) for h in held) <= len(part) + 1
        found += part
    assert found == sorted(names)


def test_an_empty_store_and_an_empty_put(spark, tmp_path):
    assert S.list_objects(spark, str(tmp_path / "none")).isEmpty()
    assert put(spark, tmp_path / "store", []).isEmpty()
    assert S.list_objects(spark, str(tmp_path / "store")).isEmpty()


def test_a_put_that_fails_leaves_nothing_visible(spark, tmp_path):
    root = tmp_path / "store"
    put(spark, root, ["a", "b"], b"old")
    frame = spark.createDataFrame([(k,) for k in ("a", "c", "d")], "name string").repartition(3)
    broken = frame.withColumn("content", F.when(F.col("name") == "d", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="lost"):
        S.put_objects(broken, str(root))
    assert rows(S.list_objects(spark, str(root), content=True), "name", "content") == [("a", bytearray(b"olda")), ("b", bytearray(b"oldb"))]


def test_attempts_that_do_not_count_and_publishing_again(spark, tmp_path):
    """A repeated task stages a second time; only what the driver noted is published, and that as often as one likes."""
    import pyarrow as pa

    root = str(tmp_path / "store")
    writer = S.PutWriter({"path": root, "run": "r"})
    batch = lambda text: pa.RecordBatch.from_pydict({"name": ["k"], "content": [text]})
    writer.write(iter([batch(b"lost attempt")]))
    counted = writer.write(iter([batch(b"counted")]))
    assert not list(S.Store(root).entries())
    writer.commit([counted, None])
    for _ in range(2):
        S.publish(spark, root, "r", "name", spark.createDataFrame([("k",)], "name string").schema)
        assert [S.Store(root).read(e.key) for e in S.Store(root).entries()] == [b"counted"]


def test_an_aborted_task_is_removed(tmp_path):
    import pyarrow as pa

    writer = S.PutWriter({"path": str(tmp_path), "run": "r"})
    message = writer.write(iter([pa.RecordBatch.from_pydict({"name": ["k"], "content": [b"x"]})]))
    writer.abort([message, None])
    assert not [p for p in (tmp_path / S.STAGED).rglob("*") if p.is_file()]


def test_a_put_object_is_moved_without_asking_about_it(tmp_path):
    """Two questions and a new folder for each object were most of the second job."""
    store, asked = S.Store(str(tmp_path)), []

    class Files:
        def __getattr__(self, name, files=store._files):
            asked.append(name)
            return getattr(files, name)

    staged = [store.stage("s", n, b"x") for n in range(20)]
    store._files = Files()
    for n, place in enumerate(staged):
        store.publish(place, f"uploads/{n}")
    assert asked.count("move") == 20 and asked.count("create_dir") == 1 and "get_file_info" not in asked
    store.publish(staged[0], "uploads/0")
    with pytest.raises(FileNotFoundError):
        store.publish(staged[0], "uploads/none")
    assert len(list(S.Store(str(tmp_path)).entries())) == 20
