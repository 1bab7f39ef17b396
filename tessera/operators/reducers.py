"""Reduce side: aggregations of (key, value). Spark sums within tasks before the shuffle, so a hot key costs a row a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exact_sum, round_half_up


def _is_integer(df: DataFrame) -> bool:
    return dict(df.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint")


def _total(df: DataFrame):
    return F.sum("value").cast("bigint") if _is_integer(df) else exact_sum(F.col("value"))


def count(df: DataFrame) -> DataFrame:
    """key, count: the sum of the values."""
    return df.groupBy("key").agg(_total(df).alias("count"))


def stats(df: DataFrame) -> DataFrame:
    """key, count (rows), sum, avg (3 places)."""
    out = df.groupBy("key").agg(F.count("*").alias("count"), _total(df).alias("sum"))
    return out.withColumn("avg", round_half_up(F.col("sum") / F.col("count"), 3))


def total(df: DataFrame) -> DataFrame:
    """key, count (rows), sum and avg as doubles (3 places)."""
    out = df.groupBy("key").agg(F.count("*").alias("count"), _total(df).cast("double").alias("raw"))
    return out.select("key", "count", round_half_up(F.col("raw"), 3).alias("sum"), round_half_up(F.col("raw") / F.col("count"), 3).alias("avg"))


def extremes(df: DataFrame) -> DataFrame:
    """stats with the smallest and largest value."""
    out = df.groupBy("key").agg(F.count("*").alias("count"), _total(df).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.withColumn("avg", round_half_up(F.col("sum") / F.col("count"), 3))
