"""Small tables for tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stackroom.schemas import CATALOG


def at(seconds: int = 0) -> dt.datetime:
    return dt.datetime(2024, 5, 1) + dt.timedelta(seconds=seconds)


def column(spark, values, expression, schema="v string"):
    """Values of ``expression(v)`` over a one-column table, in input order."""
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [row[0] for row in table.orderBy("i").select(expression(F.col("v"))).collect()]


def catalog(spark, *documents: dict):
    names = CATALOG.names
    return spark.createDataFrame([tuple(d.get(name) for name in names) for d in documents], CATALOG)


def rows(frame, *names):
    """Set of the rows of the named columns, lists as tuples."""
    frame = frame.select(*names) if names else frame
    return sorted(
        (tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in frame.collect()), key=repr
    )


def users(spark, **claims: str):
    """Users named by keyword, with their claims as JSON; uid is the position."""
    table = [(i, name, f"{name}@example.com", text) for i, (name, text) in enumerate(claims.items())]
    return spark.createDataFrame(
        table, "uid bigint, display_name string, email string, text string"
    ).select("uid", "display_name", "email", F.parse_json("text").alias("claims"))
