"""Partial updates of catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stackroom.functions import payload as P
from stackroom.functions.text import parse_list
from stackroom.operators.gate import EDIT_FIELDS, LIST_FIELDS


def edit_normalize(forms: DataFrame) -> DataFrame:
    """Form rows with the two comma-separated fields turned into lists."""
    return forms.withColumns({name: parse_list(F.col(name)) for name in LIST_FIELDS})


def fold_edits(edits: DataFrame) -> DataFrame:
    """All accepted edits of a document as one row.

    A field is set by the last edit that *has* it, be its value null; the edit's
    time is the last of all.  The aggregates combine before the shuffle, so a
    document with very many edits arrives as one row per task.
    """
    steps: list[Column] = []
    for name in EDIT_FIELDS:
        given = P.body_field(F.col("payload"), name)
        value = P.string_list(given) if name in LIST_FIELDS else P.string_value(given)
        step = F.when(given.isNotNull(), F.struct("ts", "request_id", value.alias("value")))
        steps.append(step.alias(f"new_{name}"))
    # what is sorted for the fold are the fields, not the bodies
    typed = edits.select(F.col("target_id").alias("id"), F.col("ts").alias("edited_at"), *steps)
    return typed.groupBy("id").agg(*[F.max(name).alias(name) for name in typed.columns[1:]])


def _overlaid(catalog: DataFrame, edits: DataFrame, updated_at: Column | None) -> DataFrame:
    joined = catalog.join(fold_edits(edits), "id", "left")
    changed = {
        name: F.when(F.col(f"new_{name}").isNotNull(), F.col(f"new_{name}.value")).otherwise(F.col(name))
        for name in EDIT_FIELDS
    }
    if updated_at is not None:
        changed["updated_at"] = updated_at
    return joined.withColumns(changed).select(*catalog.columns)


def edits_apply(catalog: DataFrame, edits: DataFrame) -> DataFrame:
    """Next state of the catalog: given fields written, ``updated_at`` set by any edit."""
    return _overlaid(catalog, edits, F.coalesce(F.col("edited_at"), F.col("updated_at")))


def edit_overlay(listing: DataFrame, edits: DataFrame) -> DataFrame:
    """The listing as its reader sees it right after the edits: times stay as they were."""
    return _overlaid(listing, edits, None)


def edits_rejected(gated: DataFrame) -> DataFrame:
    """Edits whose document does not exist."""
    return gated.where(F.col("status") == 404)
