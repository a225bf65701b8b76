"""From documents to packed sequences: language, lines, near-duplicates, passages, packing.

Each stage takes all documents that its predecessor kept, written as Parquet and read again,
and gives the columns of ``documents``; the last gives the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stackroom.llm import langid, lines, near, packing, substring
from stackroom.llm.common import table, written
from stackroom.operators.skew import lookup_join
from stackroom.session import prepare, remove_run_dirs, run_dirs


def _given(docs: DataFrame, *names: str) -> DataFrame:
    """All columns but text as one, beside those that a stage reads, so that none meets a result's name."""
    others = [F.col(f"`{n}`") for n in docs.columns if n != "text"]
    return docs.select(F.struct(*others, F.col("text").isNull().alias("no_text")).alias("given"), "text", *names)


def _taken(rows: DataFrame, text: str, changed: Column, names: list[str]) -> DataFrame:
    """The given columns with their text; n_chars follows where the text changed."""
    new = F.when(~F.col("given.no_text"), F.col(text))
    size = F.when(changed, F.char_length(new).cast("bigint")).otherwise(F.col("given.n_chars"))
    put = {"text": new, "n_chars": size}
    return rows.select(*[put[n].alias(n) if n in put else F.col(f"given.`{n}`") for n in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null texts, texts without letters and narrow cases go.

    Repeated rows are told alike and stay; an empty table stays empty.
    """
    told = langid.identify(_given(docs, "doc_id", "lang"), ("given", "text"))
    return _taken(told.where("accepted"), "text", F.lit(False), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later copies of repeated runs.

    Null texts stay null; repeated rows of equal doc_id and text are one place and keep their lines; rows without
    doc_id stay as they are; an empty table stays empty.
    """
    told = lines.drop_runs(_given(docs, "doc_id"))
    return _taken(told, "text", F.col("n_removed") > 0, docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row, of the smallest doc_id; rows without doc_id stay.

    Rows are told apart by a written number, as a doc_id may come again with another text.  Texts without words
    (null, empty, blank) are like no other and stay; of repeated rows one stays; an empty table stays empty.
    """
    row = F.monotonically_increasing_id().alias("row")
    rows = written(_given(docs, "doc_id").select(row, "given", F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "rows")
    told = near.classes(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"))
    told = told.where("class_size > 1").select(F.col("doc_id").alias("row"), "class_id")
    told = written(lookup_join(told, rows.select("row", "doc_id"), ["row"], "inner"), "told")
    heads = told.groupBy("class_id").agg(F.min(F.struct("doc_id", "row")).alias("head"))
    others = lookup_join(told, heads, ["class_id"], "inner").where("row <> head.row").select("row")
    return _taken(rows.join(others, "row", "left_anti"), "text", F.lit(False), docs.columns)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier.

    Null texts stay null; of rows of equal doc_id none is earlier than the other; a row without doc_id loses only
    what repeats inside it; an empty table stays empty.
    """
    told = substring.drop_repeats(_given(docs, "doc_id"), keep=("given",), kept_text=True)
    return _taken(told, "kept_text", F.col("n_removed") > 0, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts are one id, their end; each of repeated rows is packed; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("substring_dedup", dedup_passages),
    ("packing", pack_sequences),
]

# compression with dictionaries has no form in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = run_dirs(spark)
        docs = written(stage(spark, docs, sf_dir), name)
        # what the stage wrote for itself is read no more
        remove_run_dirs(spark, since=before, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
