"""Helpers shared by the text operators: inputs, written tables, workers' import path, counts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from stackroom.session import new_run_dir

BATCH_ROWS, BATCH_BYTES = "2000", "4m"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed but its folder is visible.

    Batches for Python are bounded by bytes: as many rows of text as Spark's default would
    need some hundred MB in a worker and beside the JVM's heap.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def together(keep: tuple[str, ...], results: str) -> tuple[Column, list[Column]]:
    """Columns to keep as one struct ``given``, safe from any name in between, and how to take them out again.

    Columns named like one of ``results`` (a schema) are left out: the result has that name.
    """
    taken = {part.split()[0] for part in results.split(", ")}
    names = [name for name in keep if name not in taken]
    return F.struct(*[F.col(f"`{n}`") for n in names]).alias("given"), [F.col(f"given.`{n}`") for n in names]


def shape_of(rows: DataFrame, results: str) -> T.StructType:
    """Schema of ``given`` as it is in ``rows``, whatever its columns are called, and of the results."""
    return T.StructType([rows.schema["given"], *T.StructType.fromDDL(results).fields])


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in the shared folder: lineage ends there, lost executors cost nothing."""
    path = new_run_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(rows: DataFrame, key: list[str], order: list[str], name: str, width: int | None = None) -> DataFrame:
    """Number rows from 0 within each ``key`` without bringing a key's rows together.

    Each key is dealt over ``width`` parts by a hash of ``order``; rows are numbered
    inside a part, and the parts' counts (at most ``width`` rows for a key) give
    what to add.  ``rows`` is read twice, so it should be a written table.
    """
    width = width or shuffle_width(rows.sparkSession)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(width)))
    by = [*key, "_part"]
    counts = dealt.groupBy(*by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(counts, by)
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_part", "_inside", "_before")
    )
