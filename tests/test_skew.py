"""Hot keys: a third or more of all rows under one key."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from stackroom.operators.saved import saved_fold
from stackroom.operators.skew import lookup_join

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@contextmanager
def settings(spark, values):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def facts(spark, hot):
    key = F.when(F.col("id") % 2 == 0, hot).otherwise(F.col("id") % 1000)
    return spark.range(0, 200_000, 1, 16).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))


def grouped(spark):
    """One row per key, out of a grouping by that key."""
    return spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))


def test_a_hot_key_is_split_even_where_the_rows_come_out_of_a_grouping(spark):
    with settings(spark, SMALL):
        joined = lookup_join(facts(spark, F.lit(7)), grouped(spark), ["k"])
        result = joined.collect()
        assert len(result) == 200_000 and all(row.n == 5 for row in result)
        assert "skewed" in final_plan(joined)


def test_rows_without_a_key_are_split_as_well(spark):
    with settings(spark, SMALL):
        joined = lookup_join(facts(spark, F.lit(None)), grouped(spark), ["k"])
        result = joined.collect()
        assert sum(row.n is None for row in result) == 100_000
        assert "skewed" in final_plan(joined)


def test_fold_splits_the_toggles_of_a_hot_key(spark):
    hot = F.col("id") % 2 == 0
    events = spark.range(0, 200_000, 1, 16).select(
        F.when(hot, 1).otherwise(F.col("id") % 500).alias("user_id"),
        F.when(hot, "hot").otherwise((F.col("id") % 700).cast("string")).alias("id"),
        F.when(F.col("id") == 1000, "put").otherwise("toggle").alias("op"),
        F.timestamp_seconds(F.col("id") / 10).alias("ts"),
        F.col("id").alias("seq"),
    )
    with settings(spark, SMALL):
        folded = saved_fold(events)
        result = {(row.user_id, row.id): row.saved for row in folded.collect()}
        assert "skewed" in final_plan(folded)
    later = len(range(1002, 200_000, 2))
    assert result[(1, "hot")] == (later % 2 == 0)
    assert len(result) == 1 + 1750


def test_the_last_sets_are_shuffled_once(spark):
    events = spark.range(100).selectExpr(
        "id % 9 as user_id", "'x' as id", "if(id % 2 = 0, 'put', 'toggle') as op", "timestamp_seconds(id) as ts", "id as seq"
    )
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        folded = saved_fold(events)
        folded.collect()
    assert "ReusedExchange" in final_plan(folded)
