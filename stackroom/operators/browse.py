"""Listing, searching and showing the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stackroom.functions.naming import UPLOAD_PREFIX, Bucket, download_name, title_of_object, viewer_link
from stackroom.functions.text import contains_text, format_list, or_default
from stackroom.functions.wording import MISSING
from stackroom.operators.skew import one_row


def catalog_recent(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Whole catalog, newest first; equal times by id, highest first.

    Documents without a creation time are not listed.  ``limit`` asks for a
    first page and plans as a top-k instead of a full sort.
    """
    listed = catalog.where(F.col("created_at").isNotNull()).orderBy(F.desc("created_at"), F.desc("id"))
    return listed if limit is None else listed.limit(limit)


def title_matches(catalog: DataFrame, term: str) -> DataFrame:
    """Rows whose title holds ``term`` in any case; an empty term keeps all titles."""
    return catalog.where(contains_text(F.col("title"), term))


def catalog_search(catalog: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """Search in the listing; the order stays newest first."""
    return catalog_recent(title_matches(catalog, term), limit)


def catalog_display(catalog: DataFrame) -> DataFrame:
    """Rows of the maintainer's table; missing values show as a dash."""
    return catalog.select(
        "id",
        "title",
        or_default(F.col("writer"), MISSING).alias("writer"),
        or_default(format_list(F.col("categories")), MISSING).alias("categories"),
    )


def edit_form(catalog: DataFrame) -> DataFrame:
    """The five form fields of each document, as text."""
    return catalog.select(
        "id",
        or_default(F.col("title"), "").alias("title"),
        or_default(F.col("writer"), "").alias("writer"),
        or_default(F.col("description"), "").alias("description"),
        F.coalesce(format_list(F.col("categories")), F.lit("")).alias("categories"),
        F.coalesce(format_list(F.col("tikakar")), F.lit("")).alias("tikakar"),
    )


def download_export(catalog: DataFrame) -> DataFrame:
    """File name for a download and address of the viewer page."""
    return catalog.select(
        "id", download_name(F.col("title")).alias("file_name"), viewer_link(F.col("url")).alias("viewer_url")
    )


def object_listing(objects: DataFrame, bucket: Bucket = Bucket()) -> DataFrame:
    """Uploaded objects as documents; the folder's own entry is left out."""
    name = F.col("name")
    return objects.where(F.startswith(name, F.lit(UPLOAD_PREFIX)) & (name != UPLOAD_PREFIX)).select(
        name.alias("id"), title_of_object(name).alias("title"), bucket.url(name).alias("url")
    )


def point_lookup(catalog: DataFrame, document_id: str) -> DataFrame:
    """The document with this id, or nothing."""
    return catalog.where(F.col("id") == document_id).limit(1)


def lookup_many(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """:func:`point_lookup` for a whole column of wanted ids.

    Should an id occur twice, the row that comes first in the listing is taken.
    """
    wanted = catalog.join(keys.select("id").distinct(), "id", "left_semi")
    others = [name for name in catalog.columns if name not in ("id", "created_at")]
    return one_row(wanted.select("id", "created_at", *others), ["id"]).select(*catalog.columns)


def is_empty(rows: DataFrame) -> DataFrame:
    """One row that says whether there are none; stops at the first row found."""
    return rows.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_empty"))
