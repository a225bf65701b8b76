"""Passages: against a set of all windows."""

import hashlib
import random
import re

import pytest

from stackroom.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=20):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][s : s + width]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (i, s):
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def result(docs):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.drop_repeats(docs).collect()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(make_docs, seed):
    generator = random.Random(seed)
    base = [generator.choice(["a", "b", "é", "ddd"]) for _ in range(300)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(generator.randint(0, 6)):
            if generator.random() < 0.5:
                at = generator.randint(0, 280)
                words += base[at : at + generator.randint(1, 80)]
            else:
                words += [generator.choice("abc") for _ in range(generator.randint(1, 30))]
        rows.append((i * 7 % 151, " ".join(words)))
    assert result(make_docs(rows)) == brute(rows)


def test_odd_texts(make_docs, odd_texts):
    assert result(make_docs(odd_texts)) == brute(list(enumerate(odd_texts)))


def test_many_copies_with_other_edges(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"head{i} {passage} tail{i}") for i in range(400)]
    assert result(make_docs(rows)) == brute(rows)


def test_no_doc_id_repeated_rows_and_empty_table(make_docs):
    text = " ".join(f"p{i}" for i in range(25))
    rows = substring.drop_repeats(make_docs([(None, f"{text} {text}"), (3, text), (3, text), (4, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 25), (3, 0), (3, 0), (4, 25)]
    assert substring.drop_repeats(make_docs([])).collect() == []


def test_kept_text_keeps_its_layout(make_docs):
    text = "\n".join(" ".join(f"p{i}-{j}" for j in range(10)) for i in range(3))
    docs = make_docs([(1, text), (2, f"new start\n\n{text}\nnew  end\n"), (3, None)])
    rows = substring.drop_repeats(docs, keep=("doc_id", "lang"), kept_text=True).collect()
    assert {r.doc_id: r.kept_text for r in rows} == {1: text, 2: "new start\n\nnew  end", 3: ""}
