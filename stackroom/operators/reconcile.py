"""Registering stored objects that the catalog does not know."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, functions as F

from stackroom.functions.naming import Bucket, row_key, title_of_file, title_of_object, upload_time
from stackroom.operators.browse import object_listing
from stackroom.operators.ingest import new_document
from stackroom.sources.catalog import append_batch


def unregistered(objects: DataFrame, catalog: DataFrame) -> DataFrame:
    """Uploaded objects whose path no catalog row has.

    One anti-join; a stream brings only the known paths that its names may meet.
    """
    names = object_listing(objects).select(F.col("id").alias("name"))
    return names.join(catalog.select(F.col("gcs_path").alias("name")), "name", "left_anti")


def backfill(objects: DataFrame, catalog: DataFrame, as_of: dt.datetime, bucket: Bucket = Bucket()) -> DataFrame:
    """Catalog rows for :func:`unregistered` objects, ready to be appended.

    Titles equal those of a registered upload; the creation time is the upload
    time in the name, or ``as_of`` (UTC, if it has no zone) where the name has none.
    """
    name = F.col("name")
    created_at = F.coalesce(upload_time(name), F.lit(as_of.isoformat()).cast("timestamp"))
    return unregistered(objects, catalog).select(
        row_key(name).alias("id"),
        *new_document(title_of_file(title_of_object(name)), name, created_at, bucket),
    )


def backfill_count(rows: DataFrame) -> DataFrame:
    """How many rows there are to register, without registering them."""
    return rows.agg(F.count(F.lit(1)).alias("processed"))


def register(rows: DataFrame, path: str, batch: int) -> int:
    """Append the rows of :func:`backfill` to the catalog at ``path``; their number is counted while they are written."""
    counted = Observation("backfill")
    append_batch(rows, path, batch, counted)
    return counted.get["processed"]
