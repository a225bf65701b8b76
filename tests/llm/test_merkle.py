"""Merkle manifest: against trees built and climbed in plain Python."""

import hashlib
import zlib

import pytest

from stackroom.llm import merkle

LOWER = str.maketrans(merkle.CAPITALS, merkle.SMALL)
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Levels of digests, from the leaves to the last one."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield level[first:i], level[i + 1 : first + 8]
        i //= 8


def brute(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row["lang"], []).append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        keyed = sorted(langs[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[lang] = keyed, tree([leaf_of(r, r["text"]) for r in keyed])
    top = tree([trees[lang][1][-1][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        keyed, levels = trees[lang]
        for i, row in enumerate(keyed):
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            folded, proof = leaf_of(row, text), ""
            for before, after in [*siblings(levels, i), *siblings(top, place)]:
                folded = digest(*before, folded, *after)
                proof += "".join(before + after)
            root = top[-1][0]
            out.append((row["doc_id"], levels[0][i], levels[-1][0], root, digest(proof), folded, folded == root))
    return sorted(out, key=repr)


def check(docs):
    rows = sorted(map(tuple, merkle.audit(docs).collect()), key=repr)
    assert rows == brute([r.asDict() for r in docs.collect()])
    return rows


def test_whole_table(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert {r[-1] for r in rows} == {True, False}


def test_odd_texts_and_nulls(make_docs, odd_texts):
    check(make_docs([*enumerate(odd_texts), (None, "x"), (None, None), (3, "b"), (3, "a"), (3, "a")]))


def test_empty_and_tiny_tables(spark, make_docs):
    assert merkle.audit(make_docs([])).collect() == []
    for n in (1, 2, 8, 9):
        check(spark.createDataFrame([(i, "T", "en", "s", 1) for i in range(n)], SHAPE))
    row = merkle.audit(make_docs([(1, "a")])).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest()


def test_many_languages(spark):
    """The languages' tree has levels of its own; lone leaves are their language's last digest."""
    rows = [(i, f"T {i}", None if i % 97 == 5 else "é" * (i % 3) + f"l{i % 97}", "s", i) for i in range(400)]
    check(spark.createDataFrame(rows, SHAPE))


def test_hot_language_over_several_blocks(spark):
    """High runs are met from several blocks; a third of all rows is one row again and again."""
    rows = [(7, "Same", "en", "s", 4) if i % 3 == 0 else (i, f"T{i}", "en" if i % 50 else "de", "s", i) for i in range(10_000)]
    check(spark.createDataFrame(rows, SHAPE).repartition(5))


def test_a_step_brings_no_more_than_a_block_to_one_key(spark):
    docs = spark.range(9000).selectExpr("id doc_id", "'t' text", "'en' lang", "'s' source", "1L n_chars")
    manifest = merkle.build(docs)
    # one row for each node and block of leaves below it
    assert manifest.runs.groupBy("name", "block").count().where("count > 1").isEmpty()
    met = merkle.climb(manifest).selectExpr("level", "shiftright(family, 12) block", "folded").groupBy("level", "block").count()
    assert met.agg({"count": "max"}).first()[0] <= (1 << merkle.BLOCK_BITS) // merkle.RUN
    assert {r.folded_root for r in merkle.proofs(manifest).collect()} == {manifest.root}


@pytest.mark.parametrize("parts", [1, 4])
def test_the_order_of_the_input_changes_nothing(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert merkle.build(docs.repartition(parts, "source")).root == merkle.build(docs).root
