"""Repeated runs of lines by distributed prefix doubling.  Only Spark's own expressions.

Every line of every document is a suffix of its document's sequence of line ids.
Doubling sorts suffixes by their first 1, 2, 4, ... lines: a suffix's rank by 2h lines
follows from its rank by h lines and that of the suffix h lines on.  Suffixes of one
rank are an interval of the suffix array whose common prefix is at least that long; its
size is the number of copies.  A suffix alone in its interval takes no more part.

Ranks are made from distinct keys with their counts, dealt by range, so a line that
fills a third of the corpus is one row there.  Once the run length asked for is
reached, all but the first suffix of an interval start a later copy; adjoining copies
make up the maximal run.  On the way there, one line or two count where they are long, and at the end
documents of fewer lines that occurred before as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stackroom.llm.common import written
from stackroom.operators.skew import lookup_join

MIN_RUN = 3
LONG = 120  # characters from which on a line, or two in a row, are a run


def _suffix_ranks(positions: DataFrame) -> DataFrame:
    """Replace the key (a, b) by ``rank``: how many suffixes of repeated keys sort before it.

    Keys that occur once are left out, with their positions.
    """
    key = ["a", "b"]
    counts = positions.groupBy(*key).agg(F.count("*").alias("_count")).where("_count > 1")
    counts = written(counts, "keys")
    parts = counts.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "ordered-keys")
    # one row for each range
    upto = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_part").agg(F.sum("_count").alias("_size"))
    before = before.select("_part", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    ranks = parts.withColumn("_inside", F.coalesce(F.sum("_count").over(inside), F.lit(0))).join(before, "_part")
    ranks = ranks.select(*key, (F.col("_before") + F.col("_inside")).alias("rank"))
    return lookup_join(positions, ranks, key, "inner").select("doc_id", "text_key", "line", "rank", "chars")


def _pair_up(ranked: DataFrame, step: int) -> DataFrame:
    """Rank of each suffix beside the rank of the suffix ``step`` lines on; gone where there is none.

    ``chars`` adds up where the two do not overlap.
    """
    ahead = Window.partitionBy("doc_id", "text_key").orderBy("line").rangeBetween(step, step)
    both = (F.col("chars") + F.first("chars").over(ahead)).alias("chars")
    return ranked.select(
        "doc_id", "text_key", "line", F.col("rank").alias("a"), F.first("rank").over(ahead).alias("b"), both
    ).where("b is not null")


PLACE = ["doc_id", "text_key", "line"]


def _later(ranked: DataFrame, length: int, least: int = 0) -> DataFrame:
    """Places whose run of ``length`` lines also starts earlier; of runs of ``least`` characters or more."""
    firsts = ranked.groupBy("rank").agg(F.min(F.struct(*PLACE)).alias("first"))
    long = ranked.where(F.col("chars") >= least) if least else ranked
    later = lookup_join(long, firsts, ["rank"], "inner").where(F.struct(*PLACE) != F.col("first"))
    return later.select(*PLACE, F.lit(length).alias("length"))


def _whole_copies(docs: DataFrame, shorter: int) -> DataFrame:
    """Documents of fewer than ``shorter`` lines whose text is that of a document of smaller doc_id."""
    split = F.size(F.split("content", "\n"))
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("content")
    )
    texts = texts.where((F.char_length("content") > 0) & (split < shorter))
    texts = texts.select("doc_id", "text_key", F.xxhash64(F.lit(1), "content").alias("b"), split.alias("length"))
    firsts = texts.groupBy("text_key", "b").agg(F.min("doc_id").alias("first"))
    later = lookup_join(texts, firsts, ["text_key", "b"], "inner").where("doc_id <> first")
    return later.select("doc_id", "text_key", F.lit(0).alias("line"), "length")


def repeated_starts(docs: DataFrame, min_run: int = MIN_RUN, long: int = LONG) -> DataFrame:
    """Where runs start that also start earlier: doc_id, text_key, runs (line and length).

    Runs have ``min_run`` lines, or one or two lines of ``long`` characters, or are whole documents.
    """
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("line", "content"),
    )
    # two hashes name a line: its text is not moved
    named = lines.select(
        *PLACE, F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b"), F.char_length("content").alias("chars")
    )
    ranked, reached = written(_suffix_ranks(named), "ranks"), 1
    found = _whole_copies(docs, min_run)
    while reached < min_run:
        if reached <= 2:
            found = found.union(_later(ranked, reached, long))
        step = min(reached, min_run - reached)
        paired = written(_pair_up(ranked, step), "pairs")
        ranked = written(_suffix_ranks(paired), "ranks")
        reached += step
    found = found.union(_later(ranked, min_run))
    return found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("line", "length"))).alias("runs"))


def drop_runs(docs: DataFrame, min_run: int = MIN_RUN, long: int = LONG) -> DataFrame:
    """Delete the lines of later copies of repeated line runs.

    Gives the columns of ``docs`` with ``text`` replaced by the lines kept, and n_lines,
    n_removed, n_runs (maximal runs deleted) and longest_run (lines of the longest); columns of ``docs`` with
    these names are replaced.  Lines are what ``\\n`` separates.  A line goes if it lies in a run that also
    starts at an earlier place: in a document of smaller doc_id, or before in the same text.  A run has
    ``min_run`` lines or more, or is one line, or two, of ``long`` characters together.  A document of fewer lines
    goes as a whole where one of smaller doc_id has the same text.  Null text stays null and has no lines; an
    empty text has one empty line.  Rows of equal doc_id and text are the same place
    and do not delete each other; of equal doc_id and other text, a hash decides which
    is earlier.  Rows without doc_id stay as they are.  An empty table gives no rows.
    """
    found = repeated_starts(docs, min_run, long)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs", "longest_run")]
    # the given columns stay together, so that none of them meets a name used here
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("given"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
    )
    joined = keyed.join(found, ["doc_id", "text_key"], "left")
    joined = joined.withColumn("_lines", F.split(F.col("given.text").cast("string"), "\n"))
    run = F.transform("runs", lambda r: F.sequence(r["line"], r["line"] + r["length"] - 1))
    joined = joined.withColumn("_gone", F.array_sort(F.array_distinct(F.flatten(run))))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    kept = F.transform(F.array_except(every, "_gone"), lambda i: F.get("_lines", i))
    text = F.when(F.col("_gone").isNull(), F.col("given.text").cast("string")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.size("_gone"), F.lit(0))
    first = F.array_except("_gone", F.transform("_gone", lambda i: i + 1))
    last = F.array_except("_gone", F.transform("_gone", lambda i: i - 1))
    longest = F.array_max(F.zip_with(first, last, lambda i, k: k - i + 1))
    has = F.col("_gone").isNotNull()
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"given.`{c}`") for c in names],
        F.when(F.col("given.text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"),
        F.when(has, removed).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(has, F.size(first)).otherwise(0).cast("bigint").alias("n_runs"),
        F.when(has, longest).otherwise(0).cast("bigint").alias("longest_run"),
    )
