"""Join of many rows to one row per key that holds up under hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_HASH = "_key_hash"


def lookup_join(facts: DataFrame, rows: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join of ``facts`` with ``rows``, which has at most one row per key.

    One key, or NULL, may hold a large part of all facts.  Adaptive execution
    splits such a partition over many tasks and reads the matching part of
    ``rows`` in each, but only where both inputs were shuffled for this very
    join.  ``rows`` often comes out of a grouping by the same keys, whose
    partitioning Spark would use as it is.  A hash of the keys as one more join
    key makes it shuffle both: one more shuffle of one row per key, and no task
    with all facts of a key.  Where ``rows`` turns out small, Spark broadcasts it.
    """
    key_hash = F.xxhash64(*on)
    return (
        facts.withColumn(_HASH, key_hash)
        .join(rows.withColumn(_HASH, key_hash), [*on, _HASH], how)
        .drop(_HASH)
    )


def one_row(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each key: the greatest by its other columns, in their order.

    With a creation time as the first of them, this is the row that comes first in the listing.
    """
    others = [name for name in rows.columns if name not in key]
    greatest = F.max(F.struct(*others)).alias("greatest")
    folded = rows.groupBy(*key).agg(greatest)
    return folded.select(*[F.col(n) if n in key else F.col(f"greatest.{n}").alias(n) for n in rows.columns])


def one_wide_row(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """:func:`one_row` of rows that carry bytes: a job over the keys alone looks for those that occur again, and
    only their rows are folded, if there are any."""
    again = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_count")).where("_count > 1").select(*key)
    if again.isEmpty():
        return rows
    folded = one_row(rows.join(again, list(key), "left_semi"), key)
    return rows.join(again, list(key), "left_anti").unionByName(folded)
