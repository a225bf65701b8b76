"""Toxicity: the grammar's weights, held-out labels, what must not matter."""

import zlib

import numpy as np
import pytest

from stackroom.llm import toxicity
from stackroom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
WORDS = {"idiot": 7.9, "lowei*": 6.5}


@pytest.fixture(scope="module")
def machine():
    return toxicity.Machine(WORDS)


def total(machine, text):
    return np.expm1(machine(text)[0])


def test_rules_of_the_grammar(machine):
    plain = total(machine, "an idiot")
    assert plain == pytest.approx(7.5)
    assert total(machine, "you idiot") > plain  # beside a target
    assert total(machine, "not an idiot") < plain  # negated
    assert total(machine, "she called him an idiot") < total(machine, "him an idiot")  # reported
    assert total(machine, "you. idiot") == pytest.approx(plain)  # another clause
    assert total(machine, "kill the process") == 0  # a threat without a target
    assert total(machine, "we kill you") == 0 and total(machine, "you we kill") > 0
    assert total(machine, "die Loweischaft") == pytest.approx(6.0)  # a stem
    assert total(machine, "IDIOT") == pytest.approx(plain)
    assert total(machine, "clean words only") == 0
    assert machine(None) == machine("") == [0.0] * 4


def test_composition_equals_reading_side_by_side():
    rules = [toxicity.window((toxicity.TARGET,), toxicity.INSULTS, 1.5, 1.0, 2), toxicity.window((toxicity.NEGATION,), toxicity.INSULTS, 0.5, 1.0, 3)]
    both = rules[0] @ rules[1]
    generator = np.random.default_rng(2)
    for _ in range(50):
        symbols = generator.integers(0, toxicity.OTHER + 1, 20)
        states, state = [0, 0], 0
        for s in symbols:
            expected = 1.0
            for i, rule in enumerate(rules):
                expected *= rule.weight[states[i]][s]
                states[i] = rule.step[states[i]][s]
            assert both.weight[state][s] == pytest.approx(expected)
            state = both.step[state][s]


def test_held_out(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, FOLDER).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    found = sum(r.predicted and toxic[r.doc_id] for r in held)
    assert found > 0.7 * sum(toxic[r.doc_id] for r in held)
    assert sum(r.predicted and not toxic[r.doc_id] for r in held) <= 0.02 * len(held)


def test_held_out_labels_and_other_columns_are_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    before = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    hidden = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source")
    assert {r.doc_id: r.score for r in toxicity.classify(other, hidden).collect()} == pytest.approx(before)


def test_odd_texts_and_labels(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    labels = spark.createDataFrame([(0, 1), (0, 0), (2, None), (None, 1), (5, 0), (99, 1)], "doc_id bigint, toxic int")
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert len(toxicity.classify(docs, none).collect()) == len(odd_texts)
    assert toxicity.classify(make_docs([]), labels).collect() == []
    assert len(toxicity.classify(make_docs([(1, "a"), (1, "a"), (None, None)]), labels).collect()) == 3
