"""The pipeline's stages, each against brute force on what its predecessor kept."""

from test_near import brute as near_brute
from test_packing import check as check_packing
from test_lines import brute as lines_brute
from test_substring import brute as passages_brute

import corpus_pipeline
from stackroom.llm import langid, substring
from stackroom.llm.common import ranked, written
from stackroom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = written(stage(spark, given, FOLDER), name)
        seen[name] = ({r.doc_id: r for r in given.collect()}, docs)
        if name != "packing":
            assert docs.columns == NAMES and docs.schema.simpleString() == given.schema.simpleString()

    given, out = seen["language_id"]
    accepted = {r.doc_id for r in langid.identify(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("accepted").collect()}
    assert {r.doc_id: r for r in out.collect()} == {i: r for i, r in given.items() if i in accepted}
    assert len(accepted) >= 0.97 * len(given)

    given, out = seen["line_dedup"]
    expected = lines_brute([(i, r.text) for i, r in given.items()])
    assert {r.doc_id: r.text for r in out.collect()} == {i: e[0] for i, e in expected.items()}
    assert all(r.n_chars == len(r.text) for r in out.collect())

    given, out = seen["near_dedup"]
    classes = near_brute([(i, r.text) for i, r in given.items()])
    assert {r.doc_id: r for r in out.collect()} == {i: r for i, r in given.items() if classes[i] == i}

    given, out = seen["substring_dedup"]
    expected = passages_brute([(i, r.text) for i, r in given.items()])
    for r in out.collect():
        n_words, n_removed, _ = expected[r.doc_id]
        assert len(r.text.split()) == n_words - n_removed
        assert n_removed or r == given[r.doc_id]
    assert {r.doc_id for r in out.collect()} == given.keys()
    check = {r.doc_id: r.n_removed for r in substring.drop_repeats(out.sparkSession.createDataFrame(list(given.values()), out.schema)).collect()}
    assert check == {i: e[1] for i, e in expected.items()}

    given, out = seen["packing"]
    check_packing(out.collect(), [(i, r.text) for i, r in given.items()])


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in ORACLE_SQL
    rows = QUERIES["pipeline"](spark, FOLDER)
    assert rows.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 150


def test_odd_documents_pass_every_stage(spark, make_docs, odd_texts):
    docs = make_docs([*enumerate(odd_texts), (None, "a row without doc_id"), (3, odd_texts[3]), (3, "another text")])
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == names
    empty = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, FOLDER), name)
        assert empty.collect() == []


def test_ranks_are_dense_within_each_key(spark):
    rows = written(spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 0, id % 7) AS key"), "rows")
    found = {}
    for r in ranked(rows, ["key"], ["id"], "rank", 5).collect():
        found.setdefault(r.key, []).append(r["rank"])
    assert all(sorted(ranks) == list(range(len(ranks))) for ranks in found.values()) and len(found) == 7


def test_rows_of_one_doc_id_are_apart_in_near_dedup(spark, make_docs):
    copied, clean = (" ".join(f"{name}{i}" for i in range(60)) for name in "ab")
    docs = make_docs([(1, copied), (7, copied + " more"), (7, clean), (2, clean + " more"), (3, "c d e"), (3, "c d e"), (9, clean[::-1]), (9, "f g h"), (None, copied)])
    kept = corpus_pipeline.dedup_near(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    expected = {(1, copied), (2, clean + " more"), (3, "c d e"), (9, clean[::-1]), (9, "f g h"), (None, copied)}
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(found) == expected and len(found) == len(expected)
    docs = make_docs([(1, copied), (4, copied + " more"), (4, clean)])
    assert {(r.doc_id, r.text) for r in corpus_pipeline.dedup_near(spark, docs, FOLDER).collect()} == {(1, copied), (4, clean)}
