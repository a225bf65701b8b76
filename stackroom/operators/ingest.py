"""From upload manifests to targets, catalog rows and stored bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stackroom.functions import payload as P
from stackroom.functions.naming import Bucket, expires_at, row_key, storage_path, title_of_file
from stackroom.operators.skew import lookup_join, one_wide_row

# Fixed value: the one file type the picker offers.
PDF = "application/pdf"


def manifest_files(uploads: DataFrame) -> DataFrame:
    """One row per file of each accepted manifest, with its position.

    ``file_status`` is 200, or 500 for an entry without a file name; such an
    entry rejects itself, not the rest of its manifest.
    """
    spark = uploads.sparkSession
    files = uploads.select(
        "request_id", "issued_at", P.body_field(F.col("payload"), "files").alias("files")
    ).alias("u")
    entries = files.lateralJoin(spark.tvf.variant_explode(F.col("u.files").outer()).alias("f"))
    value = F.col("f.value")
    return entries.select(
        "u.request_id",
        "u.issued_at",
        F.col("f.pos").alias("pos"),
        P.string_value(P.field(value, "fileName")).alias("file_name"),
        P.string_value(P.field(value, "fileType")).alias("file_type"),
    ).withColumn("file_status", F.when(F.col("file_name").isNull(), 500).otherwise(200))


def good_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("file_status") == 200)


def pdf_only(files: DataFrame) -> DataFrame:
    """Optional: the picker's hint as a filter.  The service itself takes any type."""
    return files.where(F.col("file_type") == PDF)


def upload_targets(files: DataFrame) -> DataFrame:
    """Where each file is to be put, until when, and with which type."""
    return good_files(files).select(
        "request_id",
        "pos",
        "file_name",
        "file_type",
        storage_path(F.col("issued_at"), F.col("file_name")).alias("storage_path"),
        "issued_at",
        expires_at(F.col("issued_at")).alias("expires_at"),
    )


def upload_register(files: DataFrame, bucket: Bucket = Bucket()) -> DataFrame:
    """The new catalog rows, one per file, ready to be appended."""
    path = storage_path(F.col("issued_at"), F.col("file_name"))
    return good_files(files).select(
        row_key(F.col("request_id"), F.col("pos")).alias("id"),
        *new_document(title_of_file(F.col("file_name")), path, F.col("issued_at"), bucket),
    )


def new_document(title: Column, path: Column, created_at: Column, bucket: Bucket) -> list[Column]:
    """All columns but the id of a catalog row that nobody has edited yet."""
    no_items = F.array().cast("array<string>")
    return [
        title.alias("title"),
        bucket.url(path).alias("url"),
        path.alias("gcs_path"),
        no_items.alias("categories"),
        F.lit("").alias("writer"),
        F.lit(None).cast("array<string>").alias("tikakar"),
        F.lit("").alias("description"),
        created_at.alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    ]


def upload_match_first(staged: DataFrame, targets: DataFrame) -> DataFrame:
    """Each staged file with the first target of its name in the same request.

    A name listed twice sends all files of that name to its first target; a file
    without a target is left out.  ``file_key`` tells a request's staged files
    apart, ``file_type`` is the file's own type.
    """
    target = F.struct("pos", "storage_path", F.col("file_type").alias("target_type"), "issued_at", "expires_at")
    first = (
        targets.groupBy("request_id", "file_name")
        .agg(F.min_by(target, "pos").alias("target"))
        .select("request_id", "file_name", "target.*")
    )
    return lookup_join(
        staged, first, ["request_id", "file_name"], how="inner"
    )


def upload_window(matches: DataFrame, put_at: Column) -> DataFrame:
    """Whether a put at ``put_at`` is still in time and has the type the target is bound to."""
    return matches.withColumns(
        {
            "put_at": put_at,
            "in_time": put_at < F.col("expires_at"),
            "type_ok": F.col("file_type").eqNullSafe(F.col("target_type")),
        }
    )


def upload_content(puts: DataFrame, staged: DataFrame) -> DataFrame:
    """The objects after all puts that hold to their target's terms: the last one for each path.

    Last is by ``put_at``, then request and ``file_key``.  The fold sees keys only; the
    bytes of each last put are then taken from ``staged``, where (request_id, file_key) names a
    file; should it occur twice, the greatest type and bytes count.  A file is put at one path, so neither
    side of that join has a hot key.
    """
    order = F.struct("put_at", "request_id", "file_key")
    last = (
        puts.where(F.col("in_time") & F.col("type_ok"))
        .groupBy("storage_path")
        .agg(F.max(order).alias("last"))
        .select("storage_path", "last.*")
    )
    key = ["request_id", "file_key"]
    files = one_wide_row(staged.select(*key, F.col("file_type").alias("content_type"), "content"), key)
    return last.join(files, key).select("storage_path", "content_type", "content", "put_at", "file_key")
