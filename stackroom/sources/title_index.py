"""An inverted index of titles: which documents have which three characters in a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stackroom.operators.browse import title_matches

GRAM = 3
PARTS = 64  # folders of postings, by a hash of the gram
RAREST = 4  # grams of a term that are looked up
POSTINGS = "gram string, id string, batch bigint, part int"


def grams(lowered: Column) -> Column:
    """The different runs of three characters, in one pass: no run is looked for from the start of the text."""
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def index_titles(catalog: DataFrame, path: str, batch: int) -> None:
    """Add the titles of these documents: all at first, then those that are new or edited.

    Writing a batch again replaces it.  Titles that a document no longer has stay in the index; a
    search reads titles from the catalog itself, so they find nothing.
    """
    # grams are told apart title by title, so a posting is shuffled once; an id that occurs twice may be posted twice
    posted = catalog.select(F.explode(grams(F.lower("title"))).alias("gram"), "id").withColumn("part", _part(F.col("gram")))
    # a folder's postings in order of their gram, so that a gram is in few row groups
    dealt = posted.hint("rebalance", "part").sortWithinPartitions("part", "gram", "id")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings/batch={batch}")
    # counted as stored: titles are taken apart once
    stored = posted.sparkSession.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("batch") == batch)
    counts = stored.groupBy("gram", "part").agg(F.count("*").alias("documents"))
    counts = counts.hint("rebalance", "part").sortWithinPartitions("part", "gram")
    counts.write.mode("overwrite").partitionBy("part").parquet(f"{path}/counts/batch={batch}")


def may_hold(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """Ids whose title may hold the term, from the folders of its rarest grams; None if it is too short to tell."""
    wanted = spark.range(1).select(F.explode(grams(F.lower(F.lit(term)))).alias("gram")).select("gram", _part(F.col("gram")).alias("part"))
    # no more rows than the term has grams
    wanted = sorted({(row.gram, row.part) for row in wanted.collect()})
    if not wanted:
        return None
    counts = spark.read.schema("gram string, documents bigint, batch bigint, part int").parquet(f"{path}/counts")
    known = _among(counts, wanted).groupBy("gram").agg(F.sum("documents").alias("documents"))
    known = {row.gram: row.documents for row in known.collect()}
    rarest = sorted(wanted, key=lambda g: (known.get(g[0], 0), g))[:RAREST]
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    found = _among(postings, rarest).groupBy("id").agg(F.count_distinct("gram").alias("grams"))
    return found.where(F.col("grams") == len(rarest)).select("id")


def _among(rows: DataFrame, wanted: list[tuple[str, int]]) -> DataFrame:
    """Rows of these grams: their folders, then their row groups."""
    return rows.where(F.col("part").isin(sorted({part for _, part in wanted})) & F.col("gram").isin([gram for gram, _ in wanted]))


def find_titles(catalog: DataFrame, path: str, term: str) -> DataFrame:
    """The rows of :func:`title_matches`, by the index where the term has three characters or more."""
    ids = may_hold(catalog.sparkSession, path, term)
    return title_matches(catalog if ids is None else catalog.join(ids, "id", "left_semi"), term)
