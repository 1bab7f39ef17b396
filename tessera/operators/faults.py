"""Scheduling and fault analytics over worker, task and fault tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE_TASKS = ("ASSIGNED", "RUNNING", "RETRYING")


def stragglers(tasks: DataFrame, threshold: float = 2.0, finished_least: int = 2) -> DataFrame:
    """Running tasks (job_id, task_id, status, elapsed) that take more than threshold times the exact median of their job's
    finished durations (above 0, at least `finished_least` of them) and aren't speculated yet."""
    done = tasks.where((F.col("status") == "SUCCEEDED") & (F.col("elapsed") > 0)).groupBy("job_id").agg(F.median("elapsed").alias("median"), F.count("*").alias("n")).where(F.col("n") >= finished_least)
    running = tasks.where((F.col("status") == "RUNNING") & ~F.coalesce(F.col("speculated"), F.lit(False)))
    return running.join(done, "job_id").where(F.col("elapsed") > F.col("median") * threshold).select("job_id", "task_id", "elapsed", "median")


def liveness(beats: DataFrame, now_ms: Column, timeout_ms: int) -> DataFrame:
    """worker_id, last_ms, status: dead if the last heartbeat is more than timeout_ms old."""
    last = beats.groupBy("worker_id").agg(F.max("ts_ms").alias("last_ms"))
    return last.withColumn("status", F.when(now_ms - F.col("last_ms") > timeout_ms, "dead").otherwise("alive"))


def load_score() -> Column:
    return F.col("running") * 1.0 + F.col("queued") * 0.5 + F.col("load1") * 0.25 + F.col("cpu_percent") * 0.01


def least_loaded(workers: DataFrame) -> DataFrame:
    """Alive workers by load score, the least loaded first; ties by id."""
    return workers.where(F.col("status") == "alive").withColumn("score", load_score()).orderBy("score", "worker_id")


def choose_worker(workers: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """The alive worker with the least load1 * 2 + cpu * 0.01; excluded ones only if no other is there."""
    score = F.col("load1") * 2 + F.col("cpu_percent") * 0.01
    out = F.col("worker_id").isin(*exclude) if exclude else F.lit(False)
    return workers.where(F.col("status") == "alive").agg(F.min_by("worker_id", F.struct(out, score, "worker_id")).alias("worker_id"))


def free_slots(workers: DataFrame, tasks: DataFrame, most: int = 3) -> DataFrame:
    """worker_id, capacity, running, free of alive workers with room; capacity is 1 to `most`, by cores."""
    running = tasks.where(F.col("status").isin(*ACTIVE_TASKS)).groupBy("worker_id").agg(F.count("*").alias("_running"))
    cores = F.when(F.coalesce(F.col("cpu_cores"), F.lit(0)) > 0, F.col("cpu_cores")).otherwise(2)
    j = workers.where(F.col("status") == "alive").join(running, "worker_id", "left").select("worker_id", F.greatest(F.lit(1), F.least(cores, F.lit(most))).cast("int").alias("capacity"), F.coalesce("_running", F.lit(0)).cast("bigint").alias("running"))
    return j.withColumn("free", F.col("capacity") - F.col("running")).where("free > 0")


def retries(tasks: DataFrame, max_attempts: int, base_ms: int) -> DataFrame:
    """Failed tasks (attempts) with next_status and delay_ms: RETRYING after base * 2 ** attempts, FAILED after the last attempt."""
    again = F.col("attempts") < max_attempts
    return tasks.withColumn("next_status", F.when(again, "RETRYING").otherwise("FAILED")).withColumn("delay_ms", F.when(again, (base_ms * F.pow(F.lit(2), F.col("attempts"))).cast("bigint")))


def reassigned(tasks: DataFrame, dead: DataFrame) -> DataFrame:
    """Active tasks of dead workers (worker_id), to be retried."""
    return tasks.where(F.col("status").isin(*ACTIVE_TASKS)).join(dead.select("worker_id"), "worker_id", "left_semi").withColumn("status", F.lit("RETRYING"))


def newest_faults(faults: DataFrame) -> DataFrame:
    return faults.orderBy(F.desc("created_ms"), F.desc("fault_id"))


def fault_counts(faults: DataFrame) -> DataFrame:
    return faults.groupBy("kind").agg(F.count("*").alias("count"))


def conflicts(updates: DataFrame, stored: DataFrame) -> DataFrame:
    """Updates (id, if_version) whose version isn't the stored one; a document that isn't stored has version 0."""
    have = stored.select(F.col("id").alias("_id"), F.col("version").alias("_version"))
    j = updates.join(have, updates["id"] == have["_id"], "left").withColumn("stored_version", F.coalesce("_version", F.lit(0)).cast("bigint"))
    return j.where(F.col("if_version") != F.col("stored_version")).drop("_id", "_version")


def bumped(previous: Column, stamped: Column) -> Column:
    return F.greatest(F.coalesce(previous, F.lit(0)) + 1, F.coalesce(stamped, F.lit(0))).cast("bigint")
