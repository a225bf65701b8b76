"""Roles of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stackroom.functions import payload as P
from stackroom.functions import wording as W
from stackroom.operators.gate import ROLE


def role_label(users: DataFrame) -> DataFrame:
    """Profile rows.  The label takes any truthy claim; the gates take only ``true``."""
    truthy = P.is_truthy(P.field(F.col("claims"), ROLE))
    return users.select(
        "uid",
        "display_name",
        "email",
        F.when(truthy, F.lit(W.MAINTAINER)).otherwise(F.lit(W.READER)).alias("role"),
    )


def grant_messages(grants: DataFrame) -> DataFrame:
    """Answer to each accepted grant."""
    return grants.select(
        "request_id",
        F.concat(F.lit(W.GRANTED_BEFORE), "email", F.lit(W.GRANTED_AFTER)).alias("message"),
    )


def role_grant(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Next users table: the claims of a granted user are replaced as a whole."""
    granted = grants.select("uid").distinct().withColumn("granted", F.lit(True))
    claims = F.when(F.col("granted"), F.parse_json(F.lit(f'{{"{ROLE}":true}}'))).otherwise(F.col("claims"))
    return users.join(granted, "uid", "left").withColumn("claims", claims).select(*users.columns)
