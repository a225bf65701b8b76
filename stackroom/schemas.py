"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_strings = T.ArrayType(T.StringType())

#: One document of the catalog.  Only id, title and url are always present.
CATALOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("gcs_path", T.StringType()),
        T.StructField("categories", _strings),
        T.StructField("writer", T.StringType()),
        T.StructField("tikakar", _strings),
        T.StructField("description", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

#: One entry of an object-store listing.
OBJECTS = T.StructType([T.StructField("name", T.StringType())])

#: One object in an inventory of the object store.
INVENTORY = T.StructType(
    [*OBJECTS, T.StructField("size", T.LongType()), T.StructField("modified", T.TimestampType())]
)

#: Bytes of one stored object, by its public address.
CONTENTS = T.StructType([T.StructField("url", T.StringType()), T.StructField("content", T.BinaryType())])

#: One document saved by one user.
MEMBERS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("id", T.StringType())])

#: One step in a user's saved set: op is put, delete or toggle.
SAVED_EVENTS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

#: One saved copy of a document.  ``size`` is NULL where there are no bytes, which can
#: thus be told without reading ``content``.
SAVED = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("size", T.LongType()),
    ]
)
