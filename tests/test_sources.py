import datetime as dt
import re

import pytest
from helpers import at, catalog, rows
from pyspark.sql import functions as F

from stackroom.functions.naming import Bucket
from stackroom.functions.payload import with_payload
from stackroom.operators import browse, edits, saved
from stackroom.schemas import CATALOG, INVENTORY
from stackroom.sources.catalog import append_batch, read_catalog, with_document_ids
from stackroom.sources.objects import read_inventory, stream_contents, stream_objects
from stackroom.sources.snapshots import read_snapshot, save_keyed, split_snapshot, write_snapshot


def library(spark):
    return catalog(
        spark,
        {"id": "1", "title": 'a "b"\n', "url": "u", "categories": [], "created_at": at(1) + dt.timedelta(microseconds=7)},
        {"id": "2", "title": "", "url": "u", "categories": ["x", None], "tikakar": [], "created_at": at(2)},
    )


def test_snapshot_round_trip(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    write_snapshot(library(spark), path)
    assert rows(read_snapshot(spark, path, CATALOG)) == rows(library(spark))


def test_stored_id_wins_over_the_key(spark):
    stored = spark.createDataFrame([("k1", "own"), ("k2", None)], "doc_key string, id string")
    assert rows(with_document_ids(stored)) == [("k2",), ("own",)]
    assert rows(with_document_ids(stored.drop("id"))) == [("k1",), ("k2",)]


def test_appending_a_batch_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "catalog")
    append_batch(library(spark), path, 1)
    append_batch(library(spark).withColumn("id", F.concat("id", F.lit("b"))), path, 2)
    append_batch(library(spark), path, 1)
    assert rows(read_catalog(spark, path), "id") == [("1",), ("1b",), ("2",), ("2b",)]


def test_an_inventory_has_every_name(spark, tmp_path):
    names = ["uploads/1-a.pdf", "uploads/_draft.pdf", "uploads/.pdf", "uploads/_sub/2-b.pdf", "uploads/n._COPYING_", "other/z.pdf"]
    path = str(tmp_path / "inventory")
    spark.createDataFrame([(n, 1, None) for n in names], INVENTORY).write.parquet(path)
    listed = browse.object_listing(read_inventory(spark, path))
    assert rows(listed, "id") == sorted((n,) for n in names[:-1])


def test_arriving_files_as_contents(spark, tmp_path):
    root = tmp_path / "uploads-root"
    for name, data in {"uploads/1-a b%.pdf": b"x", "uploads/1-uploads/y.pdf": b"yy", "other/z.pdf": b"z"}.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    for kind, source, wanted in (
        ("names", stream_objects(spark, f"file://{root}/", per_trigger=1), [("uploads/1-a b%.pdf",), ("uploads/1-uploads/y.pdf",)]),
        (
            "bytes",
            stream_contents(spark, str(root), Bucket("shelf", "https://host"), per_trigger=1),
            [
                ("https://host/shelf/uploads/1-a b%.pdf", bytearray(b"x")),
                ("https://host/shelf/uploads/1-uploads/y.pdf", bytearray(b"yy")),
            ],
        ),
    ):
        out = str(tmp_path / kind)
        run = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-marks")
        run = run.trigger(availableNow=True).start()
        run.awaitTermination()
        assert rows(spark.read.parquet(out)) == wanted
        assert len([p for p in run.recentProgress if p.numInputRows]) == 2


def test_a_snapshot_is_listed_after_reading(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    documents = catalog(spark, *[{"id": f"{i:03}", "title": "t", "url": "u", "created_at": at(i * 37 % 100)} for i in range(100)])
    write_snapshot(documents.repartition(7), path)
    assert len(list((tmp_path / "snapshot").glob("part-*"))) > 1
    listed = browse.catalog_recent(read_snapshot(spark, path, CATALOG)).collect()
    assert [(r.created_at, r.id) for r in listed] == sorted(((r.created_at, r.id) for r in listed), reverse=True)


def test_a_damaged_line_is_an_error(spark, tmp_path):
    path = tmp_path / "snapshot"
    write_snapshot(library(spark), str(path))
    with open(path / "part-broken.json", "w") as file:
        file.write('{"id": "3", "title": \n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_snapshot(spark, str(path), CATALOG).collect()


def test_damaged_lines_are_set_apart(spark, tmp_path):
    path, to = tmp_path / "snapshot", str(tmp_path / "split")
    write_snapshot(library(spark), str(path))
    bad = ['{"id": "3", "title": ', "[1]", '{"id": "4", "categories": 5}', "text"]
    with open(path / "part-broken.json", "w") as file:
        file.write("\n".join([*bad, "", '{"id": "5", "title": "good"}']) + "\n")
    good, damaged = split_snapshot(spark, str(path), CATALOG, to)
    assert rows(good.where("id <> '5'")) == rows(library(spark))
    assert rows(good, "id") == [("1",), ("2",), ("5",)]
    assert rows(damaged, "line") == sorted((b,) for b in bad)
    assert {r.file.rpartition("/")[2] for r in damaged.collect()} == {"part-broken.json"}
    # good lines are read back without the others
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_apart#\d+", plan)


def test_rows_that_come_again_under_another_number_add_nothing(spark, tmp_path):
    path = str(tmp_path / "catalog")
    append_batch(library(spark).unionByName(library(spark)), path, 0)
    append_batch(library(spark), path, 1)
    assert rows(read_catalog(spark, path), "id") == [("1",), ("2",)]
    more = library(spark).unionByName(library(spark).withColumn("id", F.lit("3")).limit(1))
    append_batch(more, path, 2)
    assert rows(read_catalog(spark, path), "id") == [("1",), ("2",), ("3",)]


def unshuffled_left_side(frame):
    """The part of the final plan between its join and the join's first shuffle."""
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.split("SortMergeJoin")[1].split("Exchange")[0]


def test_changes_of_a_keyed_table_do_not_shuffle_it(spark, tmp_path):
    copies = spark.range(100).selectExpr(
        "id user_id", "cast(id as string) id", "'t' title", "x'00' content", "cast(1 as bigint) size"
    )
    requests = spark.range(10).selectExpr(
        "id request_id", "timestamp_seconds(id) ts", "cast(id as string) target_id", """'{"title":"new"}' body"""
    )
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = save_keyed(copies, "kept", str(tmp_path / "kept"), ["user_id", "id"], 8)
        after = saved.saved_delete(kept, copies.where("user_id < 10"))
        assert len(after.collect()) == 90
        scan = unshuffled_left_side(after)
        assert "FileScan" in scan and "content" in scan

        documents = save_keyed(library(spark), "documents", str(tmp_path / "documents"), ["id"], 8)
        edited = edits.edits_apply(documents, with_payload(requests))
        assert rows(edited, "id", "title") == [("1", "new"), ("2", "new")]
        edited.collect()
        scan = unshuffled_left_side(edited)
        assert "FileScan" in scan and "description" in scan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table if exists kept")
        spark.sql("drop table if exists documents")
