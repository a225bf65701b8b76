"""Quality: held-out labels, use of the pool, what has no label."""

import zlib

import numpy as np
import pytest

from stackroom.llm import quality
from stackroom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out(spark):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op5_quality"](spark, FOLDER).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in held) > 0.95 * len(held)
    assert all(r.predicted for r in held if good[r.doc_id])  # clean documents stay


def test_held_out_labels_are_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    before = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    hidden = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 3 = 1, 1 - quality, quality) AS quality")
    assert {r.doc_id: r.score for r in quality.classify(docs, hidden).collect()} == pytest.approx(before)


def test_the_partitioning_changes_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    runs = [
        {r.doc_id: (r.score, r.predicted) for r in quality.classify(d, lab).collect()}
        for d, lab in ((docs, labels), (docs.repartition(7), labels.repartition(3)), (docs.orderBy("source", "text"), labels.orderBy("toxic")))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_a_refit_in_plain_numpy_gives_the_same(spark):
    """Views collected, everything else done here: choice of rows, order, training, scores."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    views = {r.doc_id: r for r in quality.views(docs).collect()}
    told = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    taught = sorted(told)
    checks = {
        r.doc_id: r.c for r in labels.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 'checks'), {quality.CHECKS}) = 0 as c").collect()
    }
    stack = lambda ids, name: np.array([views[i][name] for i in ids])
    model = quality.co_train(
        [stack(taught, n) for n in quality.NAMES],
        np.array([float(told[i]) for i in taught]),
        [stack(sorted(views), n) for n in quality.NAMES],
        checks=np.array([checks[i] for i in taught]),
    )
    expected = model([stack(sorted(views), n) for n in quality.NAMES])
    assert [scores[i] for i in sorted(views)] == pytest.approx(list(expected), abs=1e-9)


def test_a_view_learns_from_the_other():
    """One view is clear, the other has seen few labels: with the pool it becomes as good."""
    generator = np.random.default_rng(4)

    def rows(n):
        y = (generator.random(n) < 0.6).astype(float)
        clear = np.column_stack([4 * y - 2 + 0.3 * generator.standard_normal(n)])
        weak = y[:, None] * 0.6 + generator.standard_normal((n, 12))
        return [clear, weak], y

    known, label = rows(30)
    pool, _ = rows(8000)
    test, truth = rows(4000)
    alone = quality.co_train(known, label, [x[:0] for x in pool])
    together = quality.co_train(known, label, pool, share=0.1)
    right = [((m.logits(1, test[1]) > 0) == truth).mean() for m in (alone, together)]
    assert right[1] > right[0] + 0.05
    assert ((together(test) > 0.5) == truth).mean() > 0.97


def test_views_see_what_they_should(make_docs):
    rows = {r.doc_id: r for r in quality.views(make_docs(["a a a b", "one. two!\nthree.", None, "| x | y |", "### !!!"])).collect()}
    assert rows[0].content[2] == pytest.approx(0.5) and rows[0].content[3] == pytest.approx(0.75)
    assert rows[0].content[4] == pytest.approx(0.5)
    assert rows[1].content[9] == pytest.approx(3 / 16) and rows[1].metadata[3] == pytest.approx(0.5)
    assert rows[3].content[8] == pytest.approx(3 / 9) and rows[4].content[10] > 0.4
    assert not np.isnan([v for r in rows.values() for v in [*r.content, *r.metadata]]).any()


def test_odd_texts_and_labels(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, None), (None, 1), (5, 0), (99, 1)], "doc_id bigint, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {round(r.score, 6) for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(make_docs([]), labels).collect() == []
    assert len(quality.classify(make_docs([(1, "a"), (1, "a"), (None, None)]), labels).collect()) == 3
