"""Media: exact round trips, and members that are damaged."""

import glob
import hashlib
import os
import zlib

import pytest

from stackroom.llm import media
from stackroom.llm.queries import QUERIES


def check(rows, texts):
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in texts)
    texts = dict(texts)
    for row in rows:
        raw = (texts[row.doc_id] or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.to_png(payload)
        assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert row.feature


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op8_media"](spark, folder).collect(), [tuple(r) for r in docs])


def test_odd_texts(make_docs, odd_texts):
    rows = media.round_trip(make_docs(odd_texts)).collect()
    check(rows, list(enumerate(odd_texts)))
    same = {}
    for row in rows:
        same.setdefault(row.payload_sha256 + str(row.n_bytes), set()).add((row.media_sha256, row.feature))
    assert all(len(values) == 1 for values in same.values())


def test_repeated_rows_no_doc_id_and_empty_table(make_docs):
    rows = media.round_trip(make_docs([(1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert media.round_trip(make_docs([])).collect() == []


@pytest.fixture
def archives(spark, make_docs, tmp_path):
    media.store(make_docs([(i, f"text {i} " * 50) for i in range(200)]).repartition(3), str(tmp_path))
    return tmp_path


def test_small_ranges_read_each_member_once(spark, archives):
    media.register(spark)
    rows = spark.read.format("media_archive").option("range_bytes", 700).load(str(archives)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    assert {r.attempts for r in rows} == {1}


def test_uncommitted_archives_are_not_read(spark, archives):
    stray = sorted(glob.glob(f"{archives}/*.zip"))[0]
    with open(stray, "rb") as given, open(f"{archives}/stray.zip", "wb") as copy:
        copy.write(given.read())
    assert media.load(spark, str(archives)).count() == 200


def test_a_damaged_member_is_tried_again_and_told(spark, archives):
    first = media.load(spark, str(archives)).where("doc_id = 7").collect()[0]
    path = os.path.join(str(archives), first.archive)
    with open(path, "r+b") as file:
        file.seek(first.offset + 100)
        file.write(b"\xff\xff\xff\xff")
    rows = {r.doc_id: r for r in media.load(spark, str(archives)).collect()}
    assert len(rows) == 200
    assert (rows[7].media, rows[7].error, rows[7].attempts) == (None, "damaged member", media.ATTEMPTS)
    assert all(r.error is None and r.media for i, r in rows.items() if i != 7)
    described = {r.doc_id: r for r in media.features(media.load(spark, str(archives))).collect()}
    assert described[7].feature is None and described[8].feature


def test_a_member_that_reads_well_later_is_kept(archives, monkeypatch):
    """Each member is retried alone: a failure that passes costs one more attempt of that member only."""
    reader = media.ArchiveReader({"path": str(archives)})
    checked, failed = media._checked, set()

    def once(raw, member):
        if member.filename.startswith("0_") and member.filename not in failed:
            failed.add(member.filename)
            return None, "a passing failure"
        return checked(raw, member)

    monkeypatch.setattr(media, "_checked", once)
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert len(rows) == 200 and all(r["media"] for r in rows)
    assert sorted(r["attempts"] for r in rows)[-len(failed) :] == [2] * len(failed) and failed


def test_damaged_images_are_refused():
    stored = media.to_png(b"x" * 192)
    assert media.from_png(stored).tobytes() == b"x" * 192
    for wrong in (b"", stored[:-20] + b"\0" * 20, stored[:40] + b"\xff" + stored[41:]):
        with pytest.raises(ValueError):
            media.from_png(wrong)
