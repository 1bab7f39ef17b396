"""Results: pages, summaries, sorted merges, and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page(df: DataFrame, *order, limit: int = 200) -> DataFrame:
    """The first `limit` rows in order, each with `total` and `truncated`; the total is counted beside the top rows, not by sorting all.

    The count touches every column, so that both sides need the same shuffle and Spark runs it once.
    """
    top = df.orderBy(*order).limit(limit)
    counted = df.agg(F.when(F.max(F.xxhash64(*df.columns)).isNull(), 0).otherwise(F.count("*")).cast("bigint").alias("total"))
    return top.crossJoin(counted).withColumn("truncated", F.col("total") > limit)


def partition_summary(df: DataFrame) -> DataFrame:
    """partition, name, count of rows (partition), in order of partitions."""
    from ..functions.scalars import padded_id

    return df.groupBy("partition").agg(F.count("*").alias("count")).withColumn("name", padded_id("part", F.col("partition"))).orderBy("partition")


def newest(df: DataFrame, created: str, tie: str, limit: int = 10) -> DataFrame:
    return df.orderBy(F.desc(created), tie).limit(limit)


def task_list(df: DataFrame, kind: str | None = None) -> DataFrame:
    return (df if kind is None else df.where(F.col("kind") == kind)).orderBy("kind", "index")


def with_worker_name(tasks: DataFrame, workers: DataFrame) -> DataFrame:
    """tasks (worker_id) with worker_name, empty without a worker; Spark broadcasts the workers where they are few."""
    names = workers.select(F.col("worker_id").alias("_w"), F.col("name").alias("_name"))
    return tasks.join(names, tasks["worker_id"] == names["_w"], "left").withColumn("worker_name", F.coalesce("_name", F.lit(""))).drop("_w", "_name")


def merge_sorted(parts: list[DataFrame], key: str, descending: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc(key) if descending else F.asc(key))


def fold_documents(df: DataFrame, key: str, order: str, value: str, initial, merge) -> DataFrame:
    """key, folded: merge(accumulator, value) over a key's documents in order. A key's documents are gathered in one row."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("docs"))
    return rows.select(key, F.aggregate("docs", initial, lambda acc, x: merge(acc, x["v"])).alias("folded"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header of all columns, the key among them."""
    df.write.mode("overwrite").option("header", True).csv(path)


def store_results(df: DataFrame, path: str, partitions: int) -> None:
    """A job's reduced rows (key, ...) as JSON lines, a folder for each partition of their keys."""
    from .partitioning import partition_of

    df.withColumn("partition", partition_of(F.col("key"), partitions)).write.mode("overwrite").partitionBy("partition").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored results with their partition, in order of partitions and keys."""
    return spark.read.schema(f"{schema}, partition int").json(path).orderBy("partition", "key")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Replace a table. Spark removes the old files before it commits the new ones: a reader meanwhile may see neither."""
    df.write.mode("overwrite").parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))
