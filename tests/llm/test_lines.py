"""Runs of lines: against a set of all runs; no Python in the plan."""

import itertools
import random

import pytest
from comparing import database, difference

from stackroom.llm import lines
from stackroom.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, run=3, long=120):
    split = {i: t.split("\n") if t is not None else [] for i, t in rows}
    first, whole = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        whole.setdefault(t, i)
        for n in (1, 2, run):
            for s in range(len(split[i]) - n + 1):
                first.setdefault(tuple(split[i][s : s + n]), (i, s))
    out = {}
    for i, t in rows:
        gone = set()
        for n in (1, 2, run):
            for s in range(len(split[i]) - n + 1):
                lines_ = tuple(split[i][s : s + n])
                if first[lines_] != (i, s) and (n >= run or sum(map(len, lines_)) >= long):
                    gone.update(range(s, s + n))
        if t and len(split[i]) < run and whole[t] != i:
            gone.update(range(len(split[i])))
        text = None if t is None else "\n".join(x for k, x in enumerate(split[i]) if k not in gone)
        longest = max((len(list(g)) for _, g in itertools.groupby(sorted(gone), lambda k, c=itertools.count(): k - next(c))), default=0)
        out[i] = (text, len(split[i]), len(gone), sum(k - 1 not in gone for k in gone), longest)
    return out


def result(docs, run=3, long=120):
    rows = lines.drop_runs(docs, run, long).collect()
    return {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs, r.longest_run) for r in rows}


def test_whole_table_in_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert difference(QUERIES["op9_line_dedup"](spark, folder), database(folder), ORACLE_SQL["op9_line_dedup"]) is None


@pytest.mark.parametrize("run", [1, 2, 3, 4, 5, 7])
def test_random_lines(make_docs, run):
    generator = random.Random(run)
    rows = [(i, "\n".join(generator.choice("abc") for _ in range(generator.randint(0, 12)))) for i in range(40)]
    rows += [(100 + i, "\n".join(f"line {j}" for j in range(i, 30))) for i in range(5)]
    assert result(make_docs(rows), run) == brute(rows, run)


def test_odd_texts(make_docs, odd_texts):
    rows = list(enumerate(odd_texts))
    assert result(make_docs(rows)) == brute(rows)


def test_no_doc_id_repeated_rows_and_empty_table(make_docs):
    text = "a\nb\nc\nd"
    docs = make_docs([(None, text), (2, text), (2, text), (3, text)])
    rows = lines.drop_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (2, 0), (2, 0), (3, 4)]
    assert {r.text for r in rows if r.doc_id == 3} == {""}
    assert lines.drop_runs(make_docs([])).collect() == []


def test_other_columns_stay(make_docs):
    docs = make_docs([(1, "a\nb\nc"), (2, "a\nb\nc")])
    kept = lines.drop_runs(docs)
    assert kept.columns == [*docs.columns, "n_lines", "n_removed", "n_runs", "longest_run"]
    assert lines.drop_runs(kept).columns == kept.columns


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.drop_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Pandas", "Arrow", "CartesianProduct") if node in plan]


@pytest.mark.parametrize("run,long", [(3, 3), (3, 4), (5, 4), (2, 3)])
def test_one_or_two_long_lines_are_a_run(make_docs, run, long):
    generator = random.Random(run * 10 + long)
    rows = [(i, "\n".join(generator.choice(["a", "bb", "ccc", "dddd"]) for _ in range(generator.randint(0, 9)))) for i in range(40)]
    assert result(make_docs(rows), run, long) == brute(rows, run, long)


def test_no_copy_of_a_whole_document_keeps_its_lines(make_docs):
    texts = ["one line", "two\nlines", "a\nb\nc\nd", "one line", "two\nlines", "a\nb\nc\nd", "one line\n", "", "", "\n", "\n"]
    rows = list(enumerate(texts))
    found = result(make_docs(rows))
    assert found == brute(rows)
    assert [found[i][0] for i in (3, 4, 5)] == [""] * 3 and found[6][0] == "one line\n"
