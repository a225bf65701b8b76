"""Object listings, and objects as they arrive."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stackroom.functions.naming import UPLOAD_PREFIX, Bucket
from stackroom.schemas import INVENTORY

# Spark's own schema of a file listing; a stream needs it spelled out.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times from an inventory table, as object stores write it (Parquet).

    The listing is data like any other: the driver holds no index of the objects, and a name
    may be anything.
    """
    return spark.read.schema(INVENTORY).parquet(path)


def object_name(path: Column, root: str) -> Column:
    """Name below the bucket's root from a file's full address."""
    folder = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/"))
    return F.regexp_extract(path, rf"\Q{folder}\E/({UPLOAD_PREFIX}.*)\z", 1)


def _arriving(spark: SparkSession, root: str, per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(f"{root.rstrip('/')}/{UPLOAD_PREFIX}")


def stream_objects(spark: SparkSession, root: str, per_trigger: int | None = None) -> DataFrame:
    """Names of new objects as they arrive, at most ``per_trigger`` files in a batch if given.

    Spark's file source passes over files and folders whose names begin with ``_`` or ``.`` and
    names that end in ``._COPYING_``; :func:`read_inventory` has them all.
    """
    return _arriving(spark, root, per_trigger).select(object_name(F.col("path"), root).alias("name"))


def stream_contents(
    spark: SparkSession, root: str, bucket: Bucket = Bucket(), per_trigger: int | None = None
) -> DataFrame:
    """Bytes of new objects under their public address, for the content table; see :func:`stream_objects`."""
    name = object_name(F.col("path"), root)
    return _arriving(spark, root, per_trigger).select(bucket.url(name).alias("url"), "content")
