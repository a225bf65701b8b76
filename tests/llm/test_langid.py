"""Language: held-out accuracy, and what has no language."""

import random
import zlib

import zstandard

from stackroom.llm import langid
from stackroom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language_id"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == lang.keys() and len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.lang_pred in set(lang.values()) for r in rows)
    assert sum(r.accepted for r in rows) > 0.98 * len(rows)


def test_held_out_rows_and_labels_are_not_seen(spark):
    """Changing lang and source of held-out rows, or dropping them, changes no prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    hidden = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(doc_id AS string)) % 4 = 2, 'xx', lang) AS lang", "'q' AS source")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(hidden).collect()} == before


def test_odd_texts(make_docs, odd_texts):
    docs = make_docs([*odd_texts, "12345 !!", "...", "the thing and the other"])
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(rows) == len(odd_texts) + 3
    no_letters = [i for i, t in enumerate([*odd_texts, "12345 !!", "..."]) if not any(c.isalpha() for c in t or "")]
    assert all((rows[i].lang_pred, rows[i].score, rows[i].accepted) == ("und", 0.0, False) for i in no_letters)
    assert all(rows[i].lang_pred == "en" for i in rows if i not in no_letters)


def test_ties_are_rejected_and_nothing_learned_is_und(make_docs):
    classify = langid.Classifier({"a": b"some words here", "b": b"some words here"})
    assert classify("quite other text")[0] == "a" and classify("quite other text")[2] < langid.MARGIN
    docs = make_docs([(4, "words without a language to learn from")])  # its lang is null
    assert [(r.lang_pred, r.accepted) for r in langid.identify(docs).collect()] == [("und", False)]


def test_empty_table_repeated_rows_no_doc_id(make_docs):
    assert langid.identify(make_docs([])).collect() == []
    rows = langid.identify(make_docs([(1, "ab cd"), (1, "ab cd"), (None, "ab cd"), (None, None)])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None", "None"]
    assert not any(r.held_out for r in rows if r.doc_id is None)


def vocabulary(generator, letters, size=60):
    return ["".join(generator.choice(letters) for _ in range(generator.randint(3, 9))) for _ in range(size)]


def invented(generator, words, count):
    return " ".join(generator.choice(words) for _ in range(count))


def told(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return {r.doc_id: r for r in langid.identify(docs).collect()}


def test_a_language_that_occurs_in_long_texts_only(spark):
    generator = random.Random(5)
    one, other = vocabulary(generator, "aeinrst"), vocabulary(generator, "oulmkdg")
    rows = [(i, invented(generator, one, 40), "short") for i in range(60)]
    rows += [(100 + i, invented(generator, other, 6000), "long") for i in range(20)]
    found = told(spark, rows)
    assert min(len(t) for _, t, lang in rows if lang == "long") > 20_000
    assert all(found[i].lang_pred == lang and found[i].accepted for i, _, lang in rows)


def test_two_hundred_languages(spark):
    """Each has a vocabulary of its own; none is left out."""
    generator = random.Random(6)
    rows = []
    for n in range(200):
        words = vocabulary(generator, generator.sample("abcdefghijklmnopqrstuvwxyz", 6), 40)
        rows += [(n * 10 + k, invented(generator, words, 80), f"l{n}") for k in range(8)]
    found = told(spark, rows)
    learned = {lang for i, _, lang in rows if not found[i].held_out}
    assert len(learned) == 200 and {r.lang_pred for r in found.values()} == learned
    held = [(i, lang) for i, _, lang in rows if found[i].held_out]
    assert sum(found[i].lang_pred == lang for i, lang in held) > 0.95 * len(held)


def test_the_rule_against_a_plain_version(spark):
    """The dictionaries as learned, everything else done here without the module's own code."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = langid.learn(docs.where(~langid.held_out()))
    for row in langid.predict(docs, dictionaries, ("doc_id", "text")).collect():
        sizes = {}
        raw = row.text.lower().encode()
        for level in langid.LEVELS:
            for lang, content in dictionaries.items():
                trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=False, write_content_size=False, write_dict_id=False)
                blocks = [raw[k : k + langid.BLOCK] for k in range(0, len(raw), langid.BLOCK)]
                sizes[lang] = sizes.get(lang, 0) + sum(len(packer.compress(block)) for block in blocks)
            first, second = sorted(sizes.values())[:2]
            if second > first:
                break
        assert row.lang_pred == min(sizes, key=lambda lang: (sizes[lang], lang))
        assert row.accepted == (second - first >= max(1e-12, langid.MARGIN * first))


def test_narrow_margins_are_few_and_hold_the_errors(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    right = {known: [r.lang_pred == lang[r.doc_id] for r in rows if r.accepted == known] for known in (True, False)}
    assert len(right[True]) > 0.98 * len(rows)
    assert sum(right[True]) > 0.985 * len(right[True])
