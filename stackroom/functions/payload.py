"""Reading of request bodies and claims, which are open JSON.

A body is kept as VARIANT so that an absent field, an explicit null and a value
stay apart, and so that a value's own JSON type can be tested before it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_payload(requests: DataFrame) -> DataFrame:
    """Add ``payload``, the parsed ``body``: NULL when the text is not exactly one JSON value.

    Spark's parser stops after the first value and ignores what follows it, so the
    text is parsed as the first of two array elements, the second being its own
    digest: text after the value then breaks the array or shifts the digest.  The
    pair is kept as it is, since cutting the value out would copy it;
    :func:`body_field` reads from it.  The steps are separate columns, which Spark
    computes once each.
    """
    pair = F.concat(F.lit("["), F.col("body"), F.lit(',"'), F.col("_digest"), F.lit('"]'))
    is_whole = F.try_variant_get("_pair", "$[1]", "string") == F.col("_digest")
    return (
        requests.withColumn("_digest", F.md5(F.col("body").cast("binary")))
        .withColumn("_pair", F.try_parse_json(pair))
        .withColumn("payload", F.when(is_whole, F.col("_pair")))
        .drop("_digest", "_pair")
    )


def payload_of(body_text: Column) -> Column:
    """``payload`` of :func:`with_payload` as one expression, for SQL functions."""
    digest = F.md5(body_text.cast("binary"))
    pair = F.try_parse_json(F.concat(F.lit("["), body_text, F.lit(',"'), digest, F.lit('"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == digest, pair)


def body(payload: Column) -> Column:
    """The whole body as VARIANT."""
    return F.try_variant_get(payload, "$[0]", "variant")


def body_field(payload: Column, name: str) -> Column:
    """Field of the body as VARIANT: NULL when absent, a JSON null when null."""
    return F.try_variant_get(payload, f"$[0].{name}", "variant")


def field(value: Column, name: str) -> Column:
    """Field of any VARIANT: NULL when absent, a JSON null when null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def json_type(value: Column) -> Column:
    """Type text of a VARIANT such as ``STRING``, ``VOID`` (null) or ``ARRAY<STRING>``."""
    return F.schema_of_variant(value)


def is_json_null(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def is_array(value: Column) -> Column:
    """Looks at the first element only; the type text would be made from all of them."""
    has_first = F.try_variant_get(value, "$[0]", "variant").isNotNull()
    return F.coalesce(has_first | (F.to_json(value) == "[]"), F.lit(False))


def string_value(value: Column) -> Column:
    """The string when the JSON value is a string, else NULL (5 is not ``'5'``)."""
    return F.when(json_type(value) == "STRING", F.try_variant_get(value, "$", "string"))


def string_list(value: Column) -> Column:
    """The list when the JSON value is an array of strings and nulls, else NULL."""
    return F.when(
        json_type(value).isin("ARRAY<STRING>", "ARRAY<VOID>"),
        F.try_variant_get(value, "$", "array<string>"),
    )


def is_true(value: Column) -> Column:
    """Strict: only the JSON value ``true``."""
    return F.coalesce(
        (json_type(value) == "BOOLEAN") & F.try_variant_get(value, "$", "boolean"), F.lit(False)
    )


def is_truthy(value: Column) -> Column:
    """Loose: what a browser treats as true (``"true"``, 1, [] and {} included)."""
    kind = json_type(value)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(True))
        .when(kind != "VOID", F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )
