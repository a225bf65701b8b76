"""Packing: every id in one piece, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from stackroom.llm import packing

FOLDER = "/root/testdata/sf0.001"


def reference(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append(row)
    assert by_doc.keys() == {i for i, _ in texts}
    for i, text in texts:
        ids, at = reference(text), 0
        for row in sorted(by_doc[i], key=lambda r: r.start):
            assert (row.start, row.doc_tokens) == (at, len(ids))
            assert row.length > 0 and row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    padding = 0
    for found in by_sequence.values():
        at = 0
        for row in sorted(found, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= capacity and {r.sequence_tokens for r in found} == {at}
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / (padding + sum(r.length for r in rows))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check(packing.pack(docs).collect(), texts) < 0.05


def test_odd_texts(make_docs, odd_texts):
    assert check(packing.pack(make_docs(odd_texts)).collect(), list(enumerate(odd_texts))) < 1


def test_repeated_rows_and_no_doc_id(make_docs):
    rows = packing.pack(make_docs([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 3), (1, 3), (1, 3)]


def test_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == []


def test_program_covers_demand_near_its_bound():
    generator = np.random.default_rng(5)
    sizes = np.arange(1, 129)
    demand = generator.integers(0, 60, 128) + 1
    plan = packing.solve(sizes, demand, 128)
    assert (sum(n * p for n, p in plan) == demand).all()
    assert all((p * sizes).sum() <= 128 for _, p in plan)
    assert sum(n for n, _ in plan) < 1.05 * (sizes * demand).sum() / 128


def test_knapsack_equals_brute_force():
    sizes, prices = np.array([2, 3, 5]), np.array([1.0, 1.7, 2.6])
    value, patterns = packing.knapsack(prices, sizes, 11)
    every = [(a, b, c) for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11]
    assert np.isclose(value, max(np.dot(p, prices) for p in every))
    assert (patterns @ sizes <= 11).all() and (np.diag(patterns) > 0).all()
