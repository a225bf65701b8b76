"""JSON snapshots of a listing, and tables kept by their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stackroom.operators.skew import one_wide_row

# Keeps the microseconds that Spark's default JSON format cuts off.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_snapshot(listing: DataFrame, path: str) -> None:
    listing.write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a snapshot, in no order: list them again.  A damaged line is an error."""
    return spark.read.schema(schema).option("timestampFormat", TIME_FORMAT).option("mode", "FAILFAST").json(path)


_DAMAGED = "_damaged"


def split_snapshot(spark: SparkSession, path: str, schema: T.StructType, to: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a snapshot, and its damaged lines (file, line): both written below ``to`` in one pass.

    A line is damaged if it is no JSON object or a field has another type than ``schema`` says;
    empty lines are passed over, as Spark does.
    """
    fields = T.StructType([*schema, T.StructField(_DAMAGED, T.StringType())])
    reader = spark.read.schema(fields).option("timestampFormat", TIME_FORMAT)
    lines = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _DAMAGED).json(path)
    marked = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col(_DAMAGED).isNotNull().alias("_apart"))
    marked.write.partitionBy("_apart").parquet(to)
    stored = T.StructType([*fields, T.StructField("_file", T.StringType()), T.StructField("_apart", T.BooleanType())])
    back = spark.read.schema(stored).parquet(to)
    damaged = back.where(F.col("_apart")).select(F.col("_file").alias("file"), F.col(_DAMAGED).alias("line"))
    return back.where(~F.col("_apart")).select(*schema.names), damaged


def save_keyed(rows: DataFrame, table: str, path: str, key: list[str], buckets: int, fold: bool = False) -> DataFrame:
    """Save as a table bucketed and sorted by its key.

    Joins of such a table by its key leave it where it is: deleting or replacing
    records, fetching bytes, or applying edits, then shuffles only the keys or edits.
    ``fold`` keeps one row for each key (:func:`one_wide_row`).
    """
    spread = (one_wide_row(rows, key) if fold else rows).repartition(buckets, *key)
    spread.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)
