"""Deterministic partitions: hash of a key, even splits, and what a shuffle moves between them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import padded_id, round_half_up

#: Fixed value: the salt before a key; a parameter wherever keys are hashed.
SALT = "gsb-mapreduce-shuffle-v1"


def stable_hash(key: Column, salt: str = SALT) -> Column:
    """The first 8 bytes of the MD5 of salt and key, as an unsigned number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def partition_of(key: Column, partitions: int, salt: str = SALT) -> Column:
    return F.lit(0) if partitions <= 1 else (stable_hash(key, salt) % partitions).cast("int")


#: Rows that one task orders in an even split, about.
SPLIT_ROWS = 1_000_000


def pinned(df: DataFrame) -> DataFrame:
    """df computed once, into the shared folder spark.checkpoint.dir; only a local master may do without that setting."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def split_evenly(df: DataFrame, parts: int, *order: str) -> DataFrame:
    """df with `part` from 0: runs in order whose sizes differ by at most one, the larger first.

    Row numbers come from a range partition and the sizes of the partitions before it, so no task sees all rows. Ranges
    are dealt by samples, so the dealing is done once and kept: counts and numbers are of the same partitions, whatever
    columns each needs. Equal order values must not matter to the caller.
    """
    total = df.count()
    parts = max(1, min(parts, total))
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // SPLIT_ROWS))
    dealt = pinned(df.repartitionByRange(ranges, *order).withColumn("_pid", F.spark_partition_id()))
    sizes = dealt.groupBy("_pid").count()  # one row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_before")
    ranked = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order))).join(before, "_pid")
    row = F.col("_before") + F.col("_rn") - 1
    small, extra = divmod(total, parts)
    part = F.when(row < extra * (small + 1), F.floor(row / (small + 1))).otherwise(F.lit(extra) + F.floor((row - extra * (small + 1)) / max(1, small)))
    return ranked.withColumn("part", part.cast("int")).drop("_pid", "_before", "_rn")


def partition_sizes(pairs: DataFrame, partitions: int) -> DataFrame:
    """partition, records, bytes of the pairs (key, value) as they would be written, one JSON array a line.

    Keys are hashed and written as JSON once each, after their rows are counted; a pair without a value has no line.
    """
    value = F.col("value").cast("string")
    keys = pairs.groupBy("key").agg(F.count("*").alias("records"), F.count(value).alias("lines"), F.sum(F.octet_length(value)).alias("values"))
    as_json = F.to_json(F.struct("key"))
    quoted = F.octet_length(as_json.substr(F.lit(8), F.length(as_json) - 8))  # {"key":...}
    written = F.col("lines") * (quoted + len("[, ]\n")) + F.col("values")
    return keys.groupBy(partition_of(F.col("key"), partitions).alias("partition")).agg(F.sum("records").alias("records"), F.sum(written).alias("bytes"))


def shuffle_matrix(pairs: DataFrame) -> DataFrame:
    """For pairs (source, partition, bytes): partition, partition_name, num_sources, total_bytes, sources (sorted)."""
    cells = pairs.groupBy("partition", "source").agg(F.sum("bytes").cast("bigint").alias("bytes"))
    out = cells.groupBy("partition").agg(F.count("*").alias("num_sources"), F.sum("bytes").cast("bigint").alias("total_bytes"), F.array_sort(F.collect_list(F.struct("source", "bytes"))).alias("sources"))
    return out.withColumn("partition_name", padded_id("part", F.col("partition")))


def shuffle_progress(partitions: DataFrame) -> DataFrame:
    """done, total, pct over partitions with a `status`; only those that are done count."""
    done = F.count_if(F.col("status") == "done")
    return partitions.agg(done.alias("done"), F.count("*").alias("total")).withColumn("pct", F.when(F.col("total") > 0, round_half_up(F.col("done") / F.col("total") * 100, 1)).otherwise(0.0))
