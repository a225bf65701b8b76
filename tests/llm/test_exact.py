"""Exact duplicates: against grouping by the text itself."""

import hashlib

import numpy as np
import pytest

from stackroom.llm import exact
from stackroom.llm.arrays import BYTE_CODES, BYTES_BASE, prefix_sums

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows):
    texts = {i: (t or "").encode().translate(LOWER) for i, t in rows}
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t, []).append(i)
    return {
        i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t).hexdigest()) for i, t in texts.items()
    }


def result(docs):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.groups(docs).collect()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_texts(make_docs, odd_texts):
    rows = list(enumerate([*odd_texts, "É", "é", "STRASSE", "strasse", "straße", "", None]))
    assert result(make_docs(rows)) == brute(rows)


def test_texts_that_share_chunks_differ(make_docs):
    body = " ".join(f"w{i}" for i in range(3000))
    rows = [(0, body), (1, body + "x"), (2, "x" + body), (3, body.replace("w1500 ", "w1501 ")), (4, body)]
    assert result(make_docs(rows)) == brute(rows)


def test_no_doc_id_repeated_rows_and_empty_table(make_docs):
    rows = exact.groups(make_docs([(None, "a"), (3, "A"), (3, "a"), (2, "a")])).collect()
    assert [r.keep_id for r in rows] == [3] * 4 and [r.group_size for r in rows] == [4] * 4
    assert sorted(r.doc_id or 0 for r in rows if r.kept) == [3]
    assert exact.groups(make_docs([])).collect() == []


def test_chunks_of_one_key_are_told_apart(make_docs, monkeypatch):
    """With keys that say nothing, only the SHA-256 of chunks tells them apart."""
    rows = [(i, f"text {i % 3}") for i in range(9)]
    plain = exact._recipes

    def same_key(batches):
        import pyarrow as pa

        for batch in plain(batches):
            keys = batch.column("keys")
            zero = pa.ListArray.from_arrays(keys.offsets, pa.array(np.zeros(len(keys.flatten()), np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], zero, batch.column(3)], names=batch.schema.names)

    monkeypatch.setattr(exact, "_recipes", same_key)
    assert result(make_docs(rows)) == brute(rows)


@pytest.mark.parametrize("text", [b"", b"a" * 5000, bytes(range(256)) * 40])
def test_cuts_cover_a_text_and_follow_its_content(text):
    data = np.frombuffer(text + b"end" + text, np.uint8)
    at = np.array([0, len(text), len(text) + 3, len(data)])
    ends, ranges = exact.cuts(prefix_sums(BYTE_CODES[data], BYTES_BASE), at)
    first, last = ends[ranges[0] : ranges[1]], ends[ranges[2] : ranges[3]]
    assert first[-1] == len(text) and last[-1] == len(data)
    assert (first == last - len(text) - 3).all()
