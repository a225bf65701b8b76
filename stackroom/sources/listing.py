"""The catalog laid out for its two ways in: by id, and page by page in listing order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from stackroom.operators.browse import catalog_recent, point_lookup
from stackroom.operators.skew import one_row
from stackroom.schemas import CATALOG

Place = tuple[dt.datetime, str]  # created_at and id of a row


def write_by_id(catalog: DataFrame, path: str, files: int) -> None:
    """Store the catalog clustered by a hash of the id, with Bloom filters of ids in every row group.

    Hashed ids have no useful least and greatest value in a file; the filter says which row groups
    cannot have an id, so a lookup reads about one of them.
    """
    writer = catalog.repartition(files, F.xxhash64("id")).write.mode("overwrite")
    writer.option("parquet.bloom.filter.enabled#id", "true").parquet(path)


def read_by_id(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The documents with these ids, one row each, from the row groups whose filter lets an id pass.

    For a handful of ids (a page, a request); :func:`browse.lookup_many` takes a whole column of them.
    """
    rows = spark.read.schema(CATALOG).parquet(path)
    if len(ids) == 1:
        return point_lookup(rows, ids[0])
    # each id is a condition of its own: long lists would reach the file as least and greatest value only
    wanted = F.lit(False)
    for document_id in ids:
        wanted = wanted | (F.col("id") == document_id)
    others = [name for name in CATALOG.names if name not in ("id", "created_at")]
    return one_row(rows.where(wanted).select("id", "created_at", *others), ["id"]).select(*CATALOG.names)


_BOUNDS = "slice int, newest struct<created_at: timestamp, id: string>, oldest struct<created_at: timestamp, id: string>, documents bigint"


def write_listing(catalog: DataFrame, path: str, slices: int) -> None:
    """Store the listed documents in slices of the listing, newest first, with the bounds of each slice."""
    listed = catalog.where(F.col("created_at").isNotNull())
    order = [F.desc("created_at"), F.desc("id")]
    dealt = listed.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id())
    dealt.sortWithinPartitions("slice", *order).write.mode("overwrite").partitionBy("slice").parquet(f"{path}/rows")
    rows = _rows(catalog.sparkSession, path)
    place = F.struct("created_at", "id")
    bounds = rows.groupBy("slice").agg(F.max(place).alias("newest"), F.min(place).alias("oldest"), F.count("*").alias("documents"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*CATALOG, T.StructField("slice", T.IntegerType())])).parquet(f"{path}/rows")


def _behind(place: Column | str, after: Place) -> Column:
    created_at, document_id = F.col(place)["created_at"], F.col(place)["id"]
    moment = F.lit(after[0])
    return (created_at < moment) | ((created_at == moment) & (document_id < after[1]))


def page(spark: SparkSession, path: str, size: int, after: Place | None = None) -> DataFrame:
    """The next ``size`` documents of the listing behind ``after`` (the last row of the page before).

    Only slices that the page overlaps are read: the driver gets the bounds of ``size`` slices at most, as
    each holds a document.
    """
    bounds = spark.read.schema(_BOUNDS).parquet(f"{path}/bounds")
    if after is not None:
        bounds = bounds.where(_behind("oldest", after))
    wanted, documents = [], 0
    for row in bounds.orderBy("slice").limit(size + 1).collect():
        if documents >= size:
            break
        wanted.append(row.slice)
        # of the first slice some may be on the page before: it counts for nothing unless it is whole
        documents += row.documents if after is None or tuple(row.newest) < after else 0
    rows = _rows(spark, path).where(F.col("slice").isin(wanted)).drop("slice")
    if after is not None:
        moment = F.lit(after[0])
        rows = rows.where((F.col("created_at") < moment) | ((F.col("created_at") == moment) & (F.col("id") < after[1])))
    return catalog_recent(rows, size)
