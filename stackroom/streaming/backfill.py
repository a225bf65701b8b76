"""Registration of objects as they arrive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stackroom.functions.naming import Bucket
from stackroom.operators.reconcile import backfill


def backfill_stream(
    objects: DataFrame,
    catalog: DataFrame,
    path: str,
    checkpoint: str,
    as_of: dt.datetime,
    bucket: Bucket = Bucket(),
) -> StreamingQuery:
    """Append catalog rows of new objects below ``path``, as Parquet.

    A name is registered once: names seen before are in Spark's state store, one short row
    each, and names that ``catalog`` has are left out by a join with its paths, which is made anew
    in every batch.  Read the rows with ``spark.read.parquet(path)``: Spark's file sink
    lists whole batches only, so a batch that runs again counts once.  Progress reports say how many rows
    a batch registered, as ``backfill.processed`` among their observed metrics.
    """
    new = backfill(objects.dropDuplicates(["name"]), catalog, as_of, bucket)
    return (
        new.observe("backfill", F.count(F.lit(1)).alias("processed"))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
