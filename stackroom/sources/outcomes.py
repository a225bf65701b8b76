"""Gated requests as stored: good and rejected ones apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_outcomes(gated: DataFrame, path: str, batch: int) -> None:
    """Write a batch of gated requests in one pass, in folders by status.

    Good requests and the reject table with its reasons come out of the same job, so
    bodies are parsed and callers looked up once.  Nothing is shuffled for it, and
    writing a batch again replaces it.
    """
    gated.write.mode("overwrite").partitionBy("status").parquet(f"{path}/batch={batch}")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """All batches; ``gate.accepted`` and ``gate.rejected`` then read only their folders."""
    return spark.read.parquet(path)
