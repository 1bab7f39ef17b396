"""Search over log tables (ts, level, stage, task_id, worker_id, message). Stored by stage and task, filters on them prune folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search(logs: DataFrame, needle: str = "", stage: str | None = None, task_id: str | None = None, level: str | None = None, limit: int = 500) -> DataFrame:
    """The newest `limit` matching records, oldest first, each with `total` matches. Ties in time go by all the other columns."""
    for column, wanted in (("stage", stage), ("task_id", task_id), ("level", level)):
        if wanted:
            logs = logs.where(F.col(column) == wanted)
    if needle:
        columns = ("message", "level", "stage", "task_id", "worker_id")
        logs = logs.where(F.contains(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])), F.lit(needle.lower())))
    others = sorted(c for c in logs.columns if c != "ts")
    top = logs.orderBy(F.desc("ts"), *others).limit(limit)
    return top.crossJoin(logs.agg(F.count("*").alias("total"))).orderBy("ts", *others)


def scanned(logs: DataFrame, stage: str | None = None, task_id: str | None = None) -> DataFrame:
    """How many records the stage and task filters leave to look at."""
    for column, wanted in (("stage", stage), ("task_id", task_id)):
        if wanted:
            logs = logs.where(F.col(column) == wanted)
    return logs.agg(F.count("*").alias("scanned"))


def stages(logs: DataFrame) -> DataFrame:
    return logs.select("stage").distinct().orderBy("stage")


def write_log(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").partitionBy("stage", "task_id").json(path)
