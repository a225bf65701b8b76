"""BPE: the same ids and texts as the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stackroom.llm import bpe

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return ids, decoded, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def check(docs, library):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.encode(docs, keep=True).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        ids, decoded, ids_hash, decoded_hash = expected(library, texts[row.doc_id])
        assert (row.ids, row.decoded, row.n_tokens) == (ids, decoded, len(ids))
        assert (row.ids_sha256, row.decoded_sha256) == (ids_hash, decoded_hash)


def test_whole_table(spark, make_docs, library):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"), library)


def test_odd_texts(make_docs, odd_texts, library):
    more = ["ΑΣ ΣΑΣ. İ İ", "a\x85b\x1cc᠎d​e﻿f g\xa0h", "²½Ⅷ١٢3 é", "e<|endoftext|>́", "Ᲊa", "<|ENDOFTEXT|>"]
    check(make_docs(odd_texts + more), library)


def test_random_words(library):
    machine = bpe.automaton()
    known = bpe.WordIds(machine)
    generator = random.Random(7)
    for alphabet in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "aé漢\U0001f600ñ"):
        for _ in range(300):
            word = "".join(generator.choice(alphabet) for _ in range(generator.randint(1, 30)))
            ids = [i for w in machine.words(word) for i in np.frombuffer(known[w], "<u4").tolist()]
            assert ids == library.encode(word, add_special_tokens=False).ids


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    known = bpe.WordIds(bpe.automaton())
    for word in "one two three four five".split():
        assert known[word] and len(known) <= 3


def test_empty_table_and_repeated_rows(make_docs):
    assert bpe.encode(make_docs([])).collect() == []
    assert len(bpe.encode(make_docs([(1, "a"), (1, "a"), (None, None)])).collect()) == 3
