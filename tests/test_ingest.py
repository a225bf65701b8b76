import json

from helpers import at, rows, users
from pyspark.sql import functions as F

from stackroom.functions.naming import Bucket
from stackroom.operators import gate, ingest

MANIFEST = [
    {"fileName": "a.x.pdf", "fileType": "application/pdf"},
    {"fileName": "b.png", "fileType": "image/png"},
    {"fileName": "a.x.pdf", "fileType": "image/png"},
    {"fileName": 5},
    7,
    None,
    "text",
    {"fileType": "application/pdf"},
    {"fileName": "untyped", "fileType": 3},
]


def manifest_files(spark, *manifests):
    table = [(f"r{i}", at(), "Bearer t", 0, json.dumps({"files": m})) for i, m in enumerate(manifests)]
    requests = spark.createDataFrame(
        table, "request_id string, issued_at timestamp, auth_header string, caller_uid bigint, body string"
    )
    people = users(spark, ann='{"maintainer":true}')
    return ingest.manifest_files(gate.accepted(gate.gate_uploads(requests, people)))


def test_bad_entries_reject_themselves_only(spark):
    files = manifest_files(spark, MANIFEST, [])
    assert rows(files.where("file_status = 500"), "pos") == [(3,), (4,), (5,), (6,), (7,)]
    assert rows(ingest.good_files(files), "pos", "file_name", "file_type") == [
        (0, "a.x.pdf", "application/pdf"), (1, "b.png", "image/png"), (2, "a.x.pdf", "image/png"), (8, "untyped", None),
    ]


def test_register_gives_one_row_per_file_with_defaults(spark):
    new = ingest.upload_register(manifest_files(spark, MANIFEST), Bucket("shelf", "https://host"))
    assert new.select("id").distinct().count() == new.count() == 4
    first = new.where("title = 'a.x'").first()
    assert first.gcs_path == "uploads/1714521600000-a.x.pdf"
    assert first.url == "https://host/shelf/" + first.gcs_path
    assert (first.categories, first.writer, first.tikakar, first.description) == ([], "", None, "")
    assert (first.created_at, first.updated_at) == (at(), None)


def test_keys_do_not_depend_on_the_run(spark):
    once, again = (rows(ingest.upload_register(manifest_files(spark, MANIFEST)), "id") for _ in range(2))
    assert once == again


def test_pdf_only(spark):
    files = ingest.good_files(manifest_files(spark, MANIFEST))
    assert rows(ingest.pdf_only(files), "file_name") == [("a.x.pdf",)]


def staged(spark):
    table = [
        ("r0", "f1", "a.x.pdf", "application/pdf", 0, b"1"),
        ("r0", "f2", "a.x.pdf", "application/pdf", 899, b"2"),
        ("r0", "f3", "a.x.pdf", "application/pdf", 900, b"3"),
        ("r0", "f4", "a.x.pdf", "image/png", 0, b"4"),
        ("r0", "f5", "unknown.pdf", "application/pdf", 0, b"5"),
        ("r1", "f6", "a.x.pdf", "application/pdf", 0, b"6"),
    ]
    return spark.createDataFrame(
        table, "request_id string, file_key string, file_name string, file_type string, delay int, content binary"
    )


def test_first_target_of_a_name_takes_all_files_of_that_name(spark):
    targets = ingest.upload_targets(manifest_files(spark, MANIFEST))
    assert targets.where("file_name = 'a.x.pdf'").count() == 2
    assert rows(ingest.upload_match_first(staged(spark), targets), "file_key", "pos") == [
        ("f1", 0), ("f2", 0), ("f3", 0), ("f4", 0),
    ]


def test_puts_must_be_in_time_and_of_the_target_s_type(spark):
    targets = ingest.upload_targets(manifest_files(spark, MANIFEST))
    matches = ingest.upload_match_first(staged(spark), targets)
    puts = ingest.upload_window(matches, F.timestamp_add("second", F.col("delay"), F.col("issued_at")))
    assert rows(puts, "file_key", "in_time", "type_ok") == [
        ("f1", True, True), ("f2", True, True), ("f3", False, True), ("f4", True, False),
    ]
    # two files of one name are put to one path: the last that holds to the terms stays
    stored = ingest.upload_content(puts, staged(spark))
    assert rows(stored, "storage_path", "content_type", "file_key", "content") == [
        ("uploads/1714521600000-a.x.pdf", "application/pdf", "f2", bytearray(b"2")),
    ]
    plan = stored._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "content#" in line]


def test_a_staged_file_that_is_listed_again_is_put_once(spark):
    targets = ingest.upload_targets(manifest_files(spark, MANIFEST))
    other = staged(spark).where("file_key = 'f2'").withColumn("content", F.lit(b"22"))
    twice = staged(spark).union(staged(spark)).union(other)
    puts = ingest.upload_window(ingest.upload_match_first(twice, targets), F.timestamp_add("second", F.col("delay"), F.col("issued_at")))
    assert rows(ingest.upload_content(puts, twice), "storage_path", "file_key", "content") == [
        ("uploads/1714521600000-a.x.pdf", "f2", bytearray(b"22")),
    ]
