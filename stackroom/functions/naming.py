"""Names, storage paths and addresses of documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from stackroom.functions.text import encode_uri_component

# Folder of uploaded objects, public address of the object store,
# page that shows a PDF, prefix of addresses local to a device, life of a target.
UPLOAD_PREFIX = "uploads/"
PUBLIC_BASE = "https://storage.googleapis.com"
VIEWER_BASE = "https://docs.google.com/gview?embedded=true&url="
LOCAL_PREFIX = "blob:"
TARGET_LIFE = "INTERVAL 15 MINUTES"

# End of the year 9999, the last that timestamps are shown with.
LAST_MILLIS = 253_402_300_799_999


@dataclass(frozen=True)
class Bucket:
    """Where the bytes are kept."""

    name: str = "library"
    base: str = PUBLIC_BASE

    def url(self, path: Column) -> Column:
        """Public address of a path.  The path is not percent-encoded."""
        return F.concat(F.lit(f"{self.base}/{self.name}/"), path)


def title_of_file(file_name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name, r"\.[^/.]+\z", "")


def title_of_object(name: Column) -> Column:
    """Object name without folder and upload time; the extension stays."""
    bare = F.when(F.startswith(name, F.lit(UPLOAD_PREFIX)), F.substring(name, len(UPLOAD_PREFIX) + 1, 2**31 - 1))
    return F.regexp_replace(F.coalesce(bare, name), r"^\d+-", "")


def upload_time(name: Column) -> Column:
    """Upload time written into an object name, NULL where there is none that a timestamp can hold."""
    digits = F.regexp_extract(name, rf"^{UPLOAD_PREFIX}(\d+)-", 1)
    millis = F.nullif(digits, F.lit("")).try_cast("bigint")
    return F.timestamp_millis(F.when(millis <= LAST_MILLIS, millis))


def storage_path(issued_at: Column, file_name: Column) -> Column:
    """Path of an upload: folder, issue time in ms, file name."""
    return F.concat(F.lit(UPLOAD_PREFIX), F.unix_millis(issued_at).cast("string"), F.lit("-"), file_name)


def expires_at(issued_at: Column) -> Column:
    return issued_at + F.expr(TARGET_LIFE)


def row_key(*parts: Column) -> Column:
    """Key of a new row; the same input always gets the same key."""
    return F.sha2(F.concat_ws("/", *[part.cast("string") for part in parts]), 256)


def download_name(title: Column) -> Column:
    return F.concat(title, F.lit(".pdf"))


def viewer_link(url: Column) -> Column:
    """Address of the page that shows ``url``; NULL for a copy on the device."""
    return F.when(
        ~F.startswith(url, F.lit(LOCAL_PREFIX)),
        F.concat(F.lit(VIEWER_BASE), encode_uri_component(url)),
    )
