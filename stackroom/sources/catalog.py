"""The catalog as stored: one file set per batch of new rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from stackroom.schemas import CATALOG


def with_document_ids(stored: DataFrame, key: str = "doc_key") -> DataFrame:
    """Documents keyed outside their fields; a stored field ``id`` wins over the key."""
    if "id" not in stored.columns:
        return stored.withColumnRenamed(key, "id")
    return stored.withColumn("id", F.coalesce("id", key)).drop(key)


def append_batch(rows: DataFrame, path: str, batch: int, counted: Observation | None = None) -> None:
    """Append a batch of new rows, without ids that another batch holds.

    Writing the same batch again replaces it; the same rows under another number add
    nothing.  An id that is repeated inside the batch is written once.  ``counted`` gets the number of
    rows written, as ``processed``, from the job that writes them.
    """
    once = rows.dropDuplicates(["id"])
    try:
        others = read_batches(rows.sparkSession, path).where(F.col("batch") != batch)
        once = once.join(others.select("id").distinct(), "id", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    if counted is not None:
        once = once.observe(counted, F.count(F.lit(1)).alias("processed"))
    once.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path).drop("batch")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The catalog with the number of the batch that each row came in."""
    return spark.read.schema(T.StructType([*CATALOG, T.StructField("batch", T.LongType())])).parquet(path)
