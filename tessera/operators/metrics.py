"""Metrics of jobs, workers and the cluster, over sample and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import exact_sum, mean_or_zero, round_half_up

TASK_STATES = ("PENDING", "ASSIGNED", "RUNNING", "SUCCEEDED", "FAILED", "RETRYING")
JOB_ACTIVE = ("PENDING", "SHARDING", "MAP", "SHUFFLE", "REDUCE")


def task_samples(tasks: DataFrame) -> DataFrame:
    """tasks (processed, emitted, duration_ms) with records_per_sec, task_latency_ms, throughput; a duration is at least a microsecond."""
    secs = F.greatest(F.col("duration_ms") / 1000.0, F.lit(1e-6))
    return tasks.withColumn("records_per_sec", round_half_up(F.col("processed") / secs, 3)).withColumn("task_latency_ms", F.col("duration_ms").cast("double")).withColumn("throughput", round_half_up(F.col("emitted") / secs, 3))


def job_metrics(samples: DataFrame) -> DataFrame:
    """For each job: samples, totals, mean and peak of the rates that aren't 0, mean latency."""
    rate = F.when(F.col("records_per_sec") > 0, F.col("records_per_sec"))
    return samples.groupBy("job_id").agg(
        F.count("*").alias("count"), F.sum("processed").cast("bigint").alias("total_processed"), F.sum("emitted").cast("bigint").alias("total_emitted"),
        mean_or_zero(rate).alias("mean_rate"), F.coalesce(F.max(rate), F.lit(0.0)).alias("peak_rate"), mean_or_zero(F.col("task_latency_ms")).alias("mean_latency_ms"),
    )


def last_samples(samples: DataFrame, key: str, n: int, tie: str) -> DataFrame:
    """The newest n samples of each key, with their rank; Spark keeps n rows a key in each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc("ts_ms"), F.desc(tie))
    return samples.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_metrics(workers: DataFrame, samples: DataFrame) -> DataFrame:
    """Alive workers, counters, and the mean of the workers' mean cpu and load."""
    j = worker_metrics(workers, samples)
    return j.agg(
        F.count_if(F.col("status") == "alive").alias("alive"), F.count("*").alias("total"), mean_or_zero(F.col("cpu")).alias("mean_cpu"), mean_or_zero(F.col("load")).alias("mean_load"),
        F.coalesce(F.sum("completed"), F.lit(0)).cast("bigint").alias("completed"), F.coalesce(F.sum("failed"), F.lit(0)).cast("bigint").alias("failed"),
    )


def worker_metrics(workers: DataFrame, samples: DataFrame) -> DataFrame:
    """The rows behind cluster_metrics: every worker (worker_id, status, completed, failed) with the means of its samples."""
    means = samples.groupBy("worker_id").agg(mean_or_zero(F.col("cpu_percent")).alias("cpu"), mean_or_zero(F.col("load1")).alias("load"))
    return workers.join(means, "worker_id", "left")


def job_summary(tasks: DataFrame) -> DataFrame:
    """For each job: tasks, and how many of them are in every state."""
    return tasks.groupBy("job_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in TASK_STATES])


def stage_progress(tasks: DataFrame) -> DataFrame:
    """For each stage: total, done (succeeded only), pct, and a count for every state, zeros included."""
    states = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in TASK_STATES]
    out = tasks.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCEEDED").alias("done"), *states)
    return out.withColumn("pct", round_half_up(F.col("done") / F.col("total") * 100, 1))


def status_histogram(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("count"))


def overview(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.agg(F.count("*").alias("total"), F.count_if(s.isin(*JOB_ACTIVE)).alias("active"), F.count_if(s == "SUCCEEDED").alias("succeeded"), F.count_if(s == "FAILED").alias("failed"), F.count_if(s == "CANCELLED").alias("cancelled"))


def registry_summary(workers: DataFrame) -> DataFrame:
    return workers.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "alive").alias("alive"), F.count_if(F.col("status") == "dead").alias("dead"), F.array_sort(F.collect_list("worker_id")).alias("workers"))


def job_totals(tasks: DataFrame) -> DataFrame:
    """For each job: records processed and emitted by stage (map, reduce), attempts."""
    part = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("bigint")
    return tasks.groupBy("job_id").agg(*[part(k, c).alias(f"{k}_{c}") for k in ("map", "reduce") for c in ("processed", "emitted")], F.sum("attempts").cast("bigint").alias("attempts"))


def completed_total(workers: DataFrame) -> DataFrame:
    return workers.agg(F.sum("completed").cast("bigint").alias("completed"))


def resource_samples(counters: DataFrame) -> DataFrame:
    """counters (worker_id, ts_ms, busy, total, mem_used, mem_total): cpu_percent from the deltas to the sample before, mem_percent."""
    w = Window.partitionBy("worker_id").orderBy("ts_ms")
    delta = lambda c: F.col(c) - F.lag(c).over(w)
    cpu = F.when(F.col("d_total") > 0, round_half_up(F.col("d_busy") / F.col("d_total") * 100, 2)).otherwise(0.0)
    mem = F.when(F.col("mem_total") > 0, round_half_up(F.col("mem_used") / F.col("mem_total") * 100, 2)).otherwise(0.0)
    return counters.withColumn("d_busy", delta("busy")).withColumn("d_total", delta("total")).withColumn("cpu_percent", cpu).withColumn("mem_percent", mem).drop("d_busy", "d_total")


def histogram_map(df: DataFrame, key: str) -> Column:
    """One row with a map from key to count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def total_of(v: Column) -> Column:
    return exact_sum(v)
