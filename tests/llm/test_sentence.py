"""Piece encoding: the same ids and texts as the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from stackroom.llm import sentence


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return sentence.Encoder(sentence.vocabulary())


def ids_of(encoder, text):
    return [int(i) for chunk in encoder.encode(text) for i in chunk.split(",")]


def text_of(encoder, ids):
    return "".join(encoder.decode(iter([",".join(map(str, ids))] if ids else [])))


def check(docs, library):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sentence.encode(docs, keep=True).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id])
        decoded = library.decode(ids)
        assert (row.ids, row.decoded, row.n_tokens) == (ids, decoded, len(ids))
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_whole_table(spark, make_docs, library):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), library)


def test_odd_texts(make_docs, odd_texts, library):
    more = ["  two", "end  ", "a▁b", "▁", "<s>x</s>", "<0x41>", "<unk>", "�", " " * 1000 + "x" + " " * 33, "漢" * 500, "\r\n\t a"]
    check(make_docs(odd_texts + more), library)


def test_random_texts(encoder, library):
    generator = random.Random(7)
    known = encoder._vocabulary
    alphabets = ["ab", "aeinrst ", "abcdefghijklmnopqrstuvwxyz  ", known.alphabet, "  ▁a", "0123456789.,- ", list(known.scores)]
    for _ in range(4000):
        text = "".join(generator.choice(generator.choice(alphabets)) for _ in range(generator.randint(1, 40)))
        ids = ids_of(encoder, text)
        assert ids == library.encode(text)
        assert text_of(encoder, ids) == library.decode(ids)


def test_decoding_any_ids(encoder, library):
    generator = random.Random(8)
    for _ in range(2000):
        ids = [generator.choice([generator.randrange(32000), generator.randrange(260)]) for _ in range(generator.randint(0, 12))]
        assert text_of(encoder, ids) == library.decode(ids)


def test_backtracking_leaves_failed_places(encoder, library, monkeypatch):
    """Greedy longest matches alone are not the encoding: pieces are taken back."""
    taken = []
    plain = encoder.goes_before

    def counted(left, right):
        taken.append(plain(left, right))
        return taken[-1]

    monkeypatch.setattr(encoder, "goes_before", counted)
    assert ids_of(encoder, "zzqxv abcabdab undesirablenesses xaxbxaxb") == library.encode("zzqxv abcabdab undesirablenesses xaxbxaxb")
    assert not all(taken)


def test_chunks_end_at_spaces(encoder, library, monkeypatch):
    monkeypatch.setattr(sentence, "CHUNK", 5)
    for text in ("one  two   three four\nfive six", " " * 40, "x" * 30 + " y"):
        chunks = list(encoder.encode(text))
        assert [int(i) for c in chunks for i in c.split(",")] == library.encode(text)
        assert "".join(encoder.decode(iter(chunks))) == text


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(sentence, "CACHED_PARTS", 3)
    monkeypatch.setattr(sentence, "CACHED_PAIRS", 3)
    own = sentence.Encoder(sentence.vocabulary())
    for text in "one two three four five undesirablenesses".split():
        assert ids_of(own, text) and len(own._parts) <= 3 and len(own._pairs) <= 3


def test_empty_table_and_repeated_rows(make_docs):
    assert sentence.encode(make_docs([])).collect() == []
    assert len(sentence.encode(make_docs([(1, "a"), (1, "a"), (None, None)])).collect()) == 3
