"""Near-duplicates: against all pairs by brute force."""

import random
import re
from collections import Counter

import numpy as np

from stackroom.llm import near

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for j, n in common.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: root(i) for i in sets}


def result(docs):
    rows = near.classes(docs).collect()
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    sizes = Counter(r.class_id for r in rows)
    assert all(r.class_size == sizes[r.class_id] for r in rows)
    return {r.doc_id: r.class_id for r in rows}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edited_copies(make_docs):
    generator = random.Random(1)
    rows = []
    for group in range(12):
        base = [f"g{group}w{generator.randint(0, 500)}" for _ in range(200)]
        for _ in range(generator.randint(1, 25)):
            words = list(base)
            for _ in range(generator.randint(0, 5)):
                words[generator.randrange(200)] = f"x{generator.random()}"
            rows.append((len(rows), " ".join(words)))
    expected = brute(rows)
    assert len(set(expected.values())) < len(rows)
    assert result(make_docs(rows)) == expected


def test_odd_texts(make_docs, odd_texts):
    assert result(make_docs(odd_texts)) == brute(list(enumerate(odd_texts)))


def test_no_doc_id_repeated_rows_and_empty_table(make_docs):
    rows = near.classes(make_docs([(None, "a b c"), (3, "a b c"), (3, "a b c"), (2, "a B c"), (5, None)])).collect()
    assert sorted(((r.doc_id or 0), r.class_id, r.class_size, r.kept) for r in rows) == [
        (0, None, 1, True), (2, 2, 3, True), (3, 2, 3, False), (3, 2, 3, False), (5, 5, 1, True),
    ]
    assert near.classes(make_docs([])).collect() == []


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.doc_id: r.class_id for r in near.components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_sketches_agree_as_probability_jaccard():
    """Registers agree as often as the probability Jaccard similarity of the weights says."""
    generator = np.random.default_rng(3)
    elements = generator.integers(1, 2**63, 60).astype(np.uint64)
    a, b = generator.integers(0, 5, 60), generator.integers(0, 5, 60)
    b[:40] = a[:40]
    owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    seen = near.prob_min_hash(owner, np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]).astype(float), 2, 4096)
    p, q = a / a.sum(), b / b.sum()
    both = [i for i in range(60) if p[i] and q[i]]
    expected = sum(1 / sum(max(x / p[i], y / q[i]) for x, y in zip(p, q)) for i in both)
    assert abs((seen[0] == seen[1]).mean() - expected) < 0.04


def of_one_template(groups, seed):
    """Pairs of edited copies, all on one template: most buckets mix most of the groups."""
    generator = random.Random(seed)
    texts = []
    for group in range(groups):
        base = [f"t{i}" for i in range(150)] + [f"g{group}w{i}" for i in range(30)]
        for edits in (1, 2):
            words = list(base)
            for _ in range(edits):
                words[generator.randrange(180)] = f"x{generator.random()}"
            texts.append(" ".join(words))
    generator.shuffle(texts)
    return list(enumerate(texts))


def test_buckets_of_hundreds_of_classes(make_docs):
    rows = of_one_template(250, 1)
    expected = brute(rows)
    assert 100 < len(set(expected.values())) < 400
    got = {r.doc_id: r.class_id for r in near.classes(make_docs(rows), bands=8, rows=1).collect()}
    assert got == expected


def test_few_buckets_in_common_are_enough(make_docs):
    """Of four buckets no pair shares five."""
    rows = of_one_template(40, 2)
    expected = brute(rows)
    got = {r.doc_id: r.class_id for r in near.classes(make_docs(rows), bands=4, rows=1).collect()}
    assert got == expected


def test_line_repeated_another_number_of_times(make_docs):
    rows = []
    for group in range(12):
        line = " ".join(f"r{group}l{i}" for i in range(10))
        for times in (1, 50, 100):
            rows.append((len(rows), " ".join([*(f"d{group}w{i}" for i in range(300)), *[line] * times])))
    expected = brute(rows)
    assert len(set(expected.values())) == 12
    assert result(make_docs(rows)) == expected


def test_hundreds_of_classes_at_the_default_bands(make_docs):
    """1000 pairs of edited copies on one template, beside a large group of near copies."""
    generator = random.Random(9)
    rows = of_one_template(1000, 3)
    base = [f"h{i}" for i in range(120)]
    for _ in range(300):
        words = list(base)
        words[generator.randrange(120)] = f"y{generator.random()}"
        rows.append((len(rows), " ".join(words)))
    assert result(make_docs(rows)) == brute(rows)


def test_a_group_of_near_copies_is_one_tree(make_docs, monkeypatch):
    """No more pairs are tried at first than there are texts, and hardly any are left after that."""
    generator = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(generator.randint(1, 4)):
            words[generator.randrange(200)] = f"x{generator.random()}"
        rows.append((i, " ".join(words)))
    tried = []
    plain = near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *rest: tried.append(pairs.count()) or plain(pairs, *rest))
    assert result(make_docs(rows)) == brute(rows)
    assert tried[0] <= len(rows) and sum(tried) <= 2 * len(rows)


def test_each_step_leaves_the_rest_to_the_next(make_docs, monkeypatch):
    """Classes that only a later pair of members ties together."""
    base = [f"b{i}" for i in range(100)]

    def edited(first, last):
        return " ".join(f"e{i}" if first <= i < last else w for i, w in enumerate(base))

    rows = list(enumerate([edited(0, 5), edited(50, 55), edited(0, 9), edited(45, 55), " ".join(base), edited(3, 12), edited(90, 100)]))
    for bands, size in ((32, 4), (8, 1), (4, 1)):
        got = {r.doc_id: r.class_id for r in near.classes(make_docs(rows), bands=bands, rows=size).collect()}
        assert size == 4 or got == brute(rows)
