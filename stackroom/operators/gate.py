"""Outcome of each request, decided in the order the service checks them.

A gated table is the request table plus ``status`` (200 for good requests),
``reason`` and ``payload``, the parsed body.  Bodies are parsed before the joins:
after them, Spark would repeat the parse in a filter on the outcome, which it moves
below the parsing step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stackroom.functions import payload as P
from stackroom.operators.skew import lookup_join

# Start of a usable authorization header and name of the role claim.
BEARER = "Bearer "
ROLE = "maintainer"

TEXT_FIELDS = ["title", "writer", "description"]
LIST_FIELDS = ["categories", "tikakar"]
EDIT_FIELDS = ["title", "writer", "categories", "tikakar", "description"]


def _with_caller(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add what is known of the caller: ``_maintainer`` is NULL for an unknown one.

    Should a uid occur twice, all its rows must hold the claim.
    """
    claim = F.coalesce(P.is_true(P.field(F.col("claims"), ROLE)), F.lit(False))
    callers = (
        users.where(F.col("uid").isNotNull())
        .groupBy(F.col("uid").alias("caller_uid"))
        .agg(F.bool_and(claim).alias("_maintainer"))
    )
    return lookup_join(requests, callers, ["caller_uid"])


def outcome(header: Column, maintainer: Column, payload: Column, checks: list[tuple[Column, int, str]]) -> Column:
    """Status and reason of a request as a struct: those of the first check that fails; 200 when none does."""
    has_bearer = F.coalesce(F.startswith(header, F.lit(BEARER)), F.lit(False))
    steps = [
        (~has_bearer, 401, "no bearer header"),
        (maintainer.isNull(), 500, "invalid token"),
        (~maintainer, 403, "maintainers only"),
        (payload.isNull(), 500, "malformed body"),
        (P.is_json_null(P.body(payload)), 500, "body is null"),
        *checks,
    ]
    found = F.struct(F.lit(200).alias("status"), F.lit("ok").alias("reason"))
    for failed, status, reason in reversed(steps):
        rejected = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        found = F.when(failed, rejected).otherwise(found)
    return found


def _ladder(requests: DataFrame, checks: list[tuple[Column, int, str]]) -> DataFrame:
    """Adds status and reason; the columns that were looked up for them go."""
    found = outcome(F.col("auth_header"), F.col("_maintainer"), F.col("payload"), checks)
    return requests.withColumn("_outcome", found).select(
        *[name for name in requests.columns if not name.startswith("_")],
        F.col("_outcome.status").alias("status"),
        F.col("_outcome.reason").alias("reason"),
    )


def upload_checks(payload: Column) -> list[tuple[Column, int, str]]:
    return [(~P.is_array(P.body_field(payload, "files")), 400, "files is not an array")]


def gate_uploads(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Upload requests: the body must hold an array ``files`` (which may be empty)."""
    known = _with_caller(P.with_payload(requests), users)
    return _ladder(known, upload_checks(F.col("payload")))


def gate_edits(requests: DataFrame, users: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Edit requests: the target must exist and given fields must have the column's type.

    Without ``catalog`` the target is not looked for, which saves a join where the
    edits are only applied: an edit of a missing document then changes nothing.
    """
    known = _with_caller(P.with_payload(requests), users)
    checks = []
    if catalog is not None:
        targets = catalog.select(F.col("id").alias("target_id")).distinct().withColumn("_found", F.lit(True))
        known = lookup_join(known, targets, ["target_id"])
        checks.append((F.col("_found").isNull(), 404, "no such document"))
    for name in EDIT_FIELDS:
        given = P.body_field(F.col("payload"), name)
        typed = P.string_list(given) if name in LIST_FIELDS else P.string_value(given)
        wrong = given.isNotNull() & ~P.is_json_null(given) & typed.isNull()
        checks.append((wrong, 422, f"wrong type for {name}"))
    return _ladder(known, checks)


def gate_grants(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Grant requests: the body must name the email of an existing user.

    Adds the email and the ``uid`` found for it.
    """
    email = P.body_field(F.col("payload"), "email")
    known = _with_caller(P.with_payload(requests).withColumn("email", P.string_value(email)), users)
    known = user_by_email(known, users)
    return _ladder(
        known,
        [
            (~P.is_truthy(email), 400, "email is required"),
            (F.col("uid").isNull(), 500, "no user with this email"),
        ],
    )


def user_by_email(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the ``uid`` of the user who has the request's ``email``, or NULL.

    Should several users have it, the smallest uid is taken.
    """
    emails = users.where(F.col("email").isNotNull()).groupBy("email").agg(F.min("uid").alias("uid"))
    return lookup_join(requests, emails, ["email"])


def accepted(gated: DataFrame) -> DataFrame:
    return gated.where(F.col("status") == 200)


def rejected(gated: DataFrame) -> DataFrame:
    """Everything :func:`accepted` leaves out, with its reason."""
    return gated.where(F.col("status") != 200)
