"""Queries of the engine's operators over the standard tables, each with equivalent DuckDB SQL.

Tables stand in for the engine's own: `events` for samples, heartbeats, faults and logs, `orders` for tasks (customer =
job, clerk-less: o_orderkey = task), `customer` for workers. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mappers, scalars
from ..operators import faults, jobs, logs, metrics, partitioning, reducers, results
from ..sources.tables import load, synthetic_pairs, synthetic_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# SQL pieces ---------------------------------------------------------------------------------------------------------

SPLIT = f"string_split_regex(lower(text), '{mappers.SEPARATORS}')"
TOKENS = f"SELECT key, CAST(1 AS BIGINT) AS v, CAST(length(key) AS BIGINT) AS n FROM (SELECT unnest({SPLIT}) AS key FROM documents) WHERE key <> ''"
ONCE = f"SELECT key, CAST(1 AS BIGINT) AS v FROM (SELECT unnest(list_distinct({SPLIT})) AS key FROM documents) WHERE key <> ''"


def dec(v: str) -> str:
    return f"CAST(SUM(CAST({v} AS DECIMAL(28,6))) AS DOUBLE)"


def r(x: str, places: int = 3) -> str:
    s = float(10**places)
    return f"(sign({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


def reduced(rows: str, v: str, reducer: str, integer: bool) -> str:
    total = f"CAST(SUM({v}) AS BIGINT)" if integer else dec(v)
    double = f"CAST(SUM({v}) AS DOUBLE)" if integer else dec(v)
    n = "CAST(count(*) AS BIGINT)"
    columns = {
        "count": f"{total} AS count",
        "stats": f"{n} AS count, {total} AS sum, {r(f'({double} / count(*))')} AS avg",
        "sum": f"{n} AS count, {r(double)} AS sum, {r(f'({double} / count(*))')} AS avg",
        "extremes": f"{n} AS count, {total} AS sum, MIN({v}) AS min, MAX({v}) AS max, {r(f'({double} / count(*))')} AS avg",
    }[reducer]
    return f"SELECT key, {columns} FROM ({rows}) GROUP BY key"


def grep_rows(pattern: str) -> str:
    return f"SELECT '{pattern}' AS key, CAST(1 AS BIGINT) AS v FROM documents WHERE contains(lower(coalesce(text, '')), '{pattern}')"


def kv_rows(table: str, key: str, value: str) -> str:
    return f"SELECT coalesce(CAST({key} AS VARCHAR), 'unknown') AS key, coalesce(TRY_CAST({value} AS DOUBLE), 0) AS v FROM {table}"


# The mapper x reducer jobs -------------------------------------------------------------------------------------------


def job(name: str, table: str, mapper: str, reducer: str, rows: str, v: str, integer: bool, **params) -> None:
    """Register a job under name; sum_reducer results are doubles."""
    QUERIES[name] = lambda spark, d: jobs.run_job(load(spark, d, table), f"{mapper}_mapper", f"{reducer}_reducer", **params)
    SQL[name] = reduced(rows, v, reducer, integer)


for _r in ("count", "stats", "sum"):
    job(f"wordcount_{_r}", "documents", "wordcount", _r, TOKENS, "v", True)
    job(f"word_length_{_r}", "documents", "word_length", _r, TOKENS, "n", True)
    job(f"grep_{_r}", "documents", "grep", _r, grep_rows("the"), "v", True, pattern="the")
    job(f"kv_{_r}", "events", "kv", _r, kv_rows("events", "event_type", "value"), "v", False, key="event_type", value="value")
    job(f"distinct_{_r}", "documents", "distinct", _r, ONCE, "v", True)
job("grep_license", "documents", "grep", "count", grep_rows("license"), "v", True, pattern="license")
job("grep_no_match", "documents", "grep", "count", grep_rows("map"), "v", True)
job("kv_lineitem_sum", "lineitem", "kv", "sum", kv_rows("lineitem", "l_returnflag", "l_quantity"), "v", False, key="l_returnflag", value="l_quantity")
job("kv_orders_sum", "orders", "kv", "sum", kv_rows("orders", "o_custkey", "o_totalprice"), "v", False, key="o_custkey", value="o_totalprice")
job("word_length_extremes", "documents", "word_length", "extremes", TOKENS, "n", True)

# Partitioning --------------------------------------------------------------------------------------------------------

HASH = f"(CAST('0x' || substr(md5('{partitioning.SALT}' || key), 1, 16) AS UBIGINT) % 8)"


@query(f"SELECT key, CAST({HASH} AS INTEGER) AS partition FROM (SELECT DISTINCT key FROM ({TOKENS}))")
def partition_hash(spark: SparkSession, d: str) -> DataFrame:
    keys = mappers.wordcount(load(spark, d, "documents")).select("key").distinct()
    return keys.withColumn("partition", partitioning.partition_of(F.col("key"), 8))


@query(f"SELECT partition, count(*) AS records, CAST(sum(strlen(key) + 8) AS BIGINT) AS bytes FROM (SELECT key, CAST({HASH} AS INTEGER) AS partition FROM ({TOKENS})) GROUP BY partition")
def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.partition_sizes(mappers.wordcount(load(spark, d, "documents")), 8)


@query("SELECT o_orderkey, o_custkey, o_totalprice, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS part FROM orders")
def even_split(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.split_evenly(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 7, "o_orderkey")


CELLS = "SELECT o_orderkey % 8 AS source, o_custkey % 4 AS partition, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders"


def _moves(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 8).alias("source"), (F.col("o_custkey") % 4).alias("partition"), F.floor("o_totalprice").cast("bigint").alias("bytes"))


@query(
    f"""SELECT partition, 'part-' || lpad(CAST(partition AS VARCHAR), 4, '0') AS partition_name, count(*) AS num_sources, CAST(sum(b) AS BIGINT) AS total_bytes,
    string_agg(source || ':' || b, ',' ORDER BY source) AS sources FROM (SELECT source, partition, CAST(sum(bytes) AS BIGINT) AS b FROM ({CELLS}) GROUP BY ALL) GROUP BY partition"""
)
def shuffle_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = partitioning.shuffle_matrix(_moves(spark, d))
    shown = F.array_join(F.transform("sources", lambda s: F.concat(s["source"].cast("string"), F.lit(":"), s["bytes"].cast("string"))), ",")
    return m.withColumn("sources", shown)


@query("SELECT count(*) FILTER (status = 'done') AS done, count(*) AS total, floor(count(*) FILTER (status = 'done') / count(*) * 100 * 10 + 0.5) / 10 AS pct FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'ready' END AS status FROM orders)")
def shuffle_progress(spark: SparkSession, d: str) -> DataFrame:
    return partitioning.shuffle_progress(load(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("ready").alias("status")))


# Results -------------------------------------------------------------------------------------------------------------


@query(f"SELECT key, count, (SELECT count(DISTINCT key) FROM ({TOKENS})) AS total, (SELECT count(DISTINCT key) FROM ({TOKENS})) > 200 AS truncated FROM ({reduced(TOKENS, 'v', 'count', True)}) ORDER BY key LIMIT 200")
def result_page(spark: SparkSession, d: str) -> DataFrame:
    return results.page(reducers.count(mappers.wordcount(load(spark, d, "documents"))), "key", limit=200)


@query(f"SELECT partition, 'part-' || lpad(CAST(partition AS VARCHAR), 4, '0') AS name, count(*) AS count FROM (SELECT CAST({HASH} AS INTEGER) AS partition FROM (SELECT DISTINCT key FROM ({TOKENS}))) GROUP BY partition")
def result_partition_summary(spark: SparkSession, d: str) -> DataFrame:
    return results.partition_summary(partition_hash(spark, d))


@query("SELECT o_orderkey, (epoch_us(o_orderdate) // 1000) AS created_ms FROM orders ORDER BY created_ms DESC, o_orderkey LIMIT 10")
def jobs_newest_first(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", scalars.epoch_ms(F.col("o_orderdate")).alias("created_ms"))
    return results.newest(o, "created_ms", "o_orderkey")


@query("SELECT 'map' AS kind, o_orderkey AS index, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0")
def task_list(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "reduce").otherwise("map").alias("kind"), F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("status"))
    return results.task_list(o, "map")


@query("SELECT o_orderkey AS task_id, o_custkey AS worker_id, coalesce(c_name, '') AS worker_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def task_worker_names(spark: SparkSession, d: str) -> DataFrame:
    tasks = load(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("worker_id"))
    return results.with_worker_name(tasks, load(spark, d, "customer").select(F.col("c_custkey").alias("worker_id"), F.col("c_name").alias("name")))


STATE = "CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE o_orderstatus END"


@query(f"SELECT state, CASE state WHEN 'SUCCEEDED' THEN '成功 Succeeded' WHEN 'RUNNING' THEN '运行中 Running' ELSE state END AS label, count(*) AS n FROM (SELECT {STATE} AS state FROM orders) GROUP BY state")
def state_labels(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    o = load(spark, d, "orders").select(F.when(s == "F", "SUCCEEDED").when(s == "O", "RUNNING").otherwise(s).alias("state"))
    return o.groupBy("state").agg(F.count("*").alias("n")).select("state", scalars.label(scalars.STATE_LABELS, F.col("state")).alias("label"), "n")


@query(f"SELECT key, 'count=' || count || ', sum=' || sum AS cell FROM (SELECT key, count(*) AS count, CAST(sum(n) AS BIGINT) AS sum FROM ({TOKENS}) GROUP BY key)")
def value_cells(spark: SparkSession, d: str) -> DataFrame:
    s = reducers.stats(mappers.word_length(load(spark, d, "documents"))).select("key", "count", "sum")
    return s.select("key", scalars.value_cell(s.columns).alias("cell"))


@query(
    """SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE printf('%.2f', floor(n / 1048576.0::DOUBLE * 100 + 0.5) / 100) || ' MB' END AS bytes,
    CASE WHEN n < 1000 THEN n || ' ms' WHEN n < 60000 THEN printf('%.1f', floor(n / 1000.0::DOUBLE * 10 + 0.5) / 10) || ' s' ELSE printf('%.1f', floor(n / 60000.0::DOUBLE * 10 + 0.5) / 10) || ' min' END AS duration,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock FROM (SELECT *, event_id * 37 AS n FROM events)"""
)
def formatters(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") * 37
    return load(spark, d, "events").select("event_id", scalars.show_bytes(n).alias("bytes"), scalars.show_duration(n).alias("duration"), scalars.clock(scalars.epoch_ms(F.col("ts"))).alias("clock"))


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS completed FROM orders")
def completed_total(spark: SparkSession, d: str) -> DataFrame:
    return metrics.completed_total(load(spark, d, "orders").select(F.col("o_orderkey").alias("completed")))


@query("SELECT k, n FROM (SELECT o_orderkey AS k, 1 AS n FROM orders UNION ALL SELECT c_custkey, 2 FROM customer)")
def merged_sorted(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("n"))
    return results.merge_sorted([a, load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(2).alias("n"))], "k")


@query("SELECT user_id, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS folded FROM events GROUP BY user_id")
def folded_documents(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return results.fold_documents(e, "user_id", "event_id", "k", F.lit(0).cast("bigint"), lambda acc, v: acc + v)


@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    return results.json_lines(load(spark, d, "events").select("event_type", "event_id"))


# Logs ----------------------------------------------------------------------------------------------------------------

LOGS = "SELECT (epoch_us(ts) // 1000) AS ts, event_type AS level, 'events' AS stage, CAST(user_id AS VARCHAR) AS task_id, CAST(user_id % 7 AS VARCHAR) AS worker_id, props AS message FROM events"


def _logs(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select(scalars.epoch_ms(F.col("ts")).alias("ts"), F.col("event_type").alias("level"), F.lit("events").alias("stage"), F.col("user_id").cast("string").alias("task_id"), (F.col("user_id") % 7).cast("string").alias("worker_id"), F.col("props").alias("message"))


@query(f"WITH m AS (SELECT * FROM ({LOGS}) WHERE level = 'error' AND contains(lower(concat_ws(' ', message, level, stage, task_id, worker_id)), 'k\": 6')) SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY ts DESC, level, message, stage, task_id, worker_id LIMIT 500")
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return logs.search(_logs(spark, d), 'K": 6', level="error")


TALK = "SELECT conv_id * 1000 + turn AS ts, 'INFO' AS level, role AS stage, CAST(conv_id AS VARCHAR) AS task_id, '' AS worker_id, text AS message FROM conversations"


def _talk(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ts"), F.lit("INFO").alias("level"), F.col("role").alias("stage"), F.col("conv_id").cast("string").alias("task_id"), F.lit("").alias("worker_id"), F.col("text").alias("message"))


@query(f"WITH m AS (SELECT * FROM ({TALK}) WHERE stage = 'user' AND contains(lower(message), 'the')) SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY ts DESC, level, message, stage, task_id, worker_id LIMIT 50")
def log_search_stage(spark: SparkSession, d: str) -> DataFrame:
    return logs.search(_talk(spark, d), "The", stage="user", limit=50)


@query("SELECT count(*) AS scanned FROM conversations WHERE role = 'user'")
def log_scanned(spark: SparkSession, d: str) -> DataFrame:
    return logs.scanned(_talk(spark, d), stage="user")


@query("SELECT DISTINCT role AS stage FROM conversations")
def log_stages(spark: SparkSession, d: str) -> DataFrame:
    return logs.stages(_talk(spark, d))


# Metrics -------------------------------------------------------------------------------------------------------------

TASKS = "SELECT o_custkey AS job_id, o_orderkey AS task_id, o_orderkey % 1000 AS processed, o_orderkey % 100 AS emitted, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS duration_ms FROM orders"
SECS = "greatest(duration_ms / 1000.0::DOUBLE, 1e-6::DOUBLE)"
SAMPLES = f"SELECT *, {r(f'(processed / {SECS})')} AS records_per_sec, CAST(duration_ms AS DOUBLE) AS task_latency_ms, {r(f'(emitted / {SECS})')} AS throughput FROM ({TASKS})"


def _task_rows(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 1000).alias("processed"), (F.col("o_orderkey") % 100).alias("emitted"), (F.floor("o_totalprice").cast("bigint") % 5000).alias("duration_ms"))


@query(SAMPLES)
def task_samples(spark: SparkSession, d: str) -> DataFrame:
    return metrics.task_samples(_task_rows(spark, d))


def mean(v: str) -> str:
    return f"coalesce({r(f'({dec(v)} / count({v}))', 2)}, 0.0)"


@query(
    f"""SELECT job_id, count(*) AS count, CAST(sum(processed) AS BIGINT) AS total_processed, CAST(sum(emitted) AS BIGINT) AS total_emitted, {mean('rate')} AS mean_rate,
    coalesce(max(rate), 0.0) AS peak_rate, {mean('task_latency_ms')} AS mean_latency_ms FROM (SELECT *, CASE WHEN records_per_sec > 0 THEN records_per_sec END AS rate FROM ({SAMPLES})) GROUP BY job_id"""
)
def job_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.job_metrics(task_samples(spark, d))


@query("SELECT * FROM (SELECT user_id AS worker_id, event_id, (epoch_us(ts) // 1000) AS ts_ms, value AS cpu_percent, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 120")
def worker_series(spark: SparkSession, d: str) -> DataFrame:
    return metrics.last_samples(_beats(spark, d).withColumnRenamed("value", "cpu_percent"), "worker_id", 120, "event_id")


def _beats(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("user_id").alias("worker_id"), "event_id", scalars.epoch_ms(F.col("ts")).alias("ts_ms"), "value")


WORKERS = "SELECT c_custkey AS worker_id, CASE WHEN c_acctbal > 0 THEN 'alive' ELSE 'dead' END AS status, c_nationkey % 5 AS running, c_nationkey % 3 AS queued, CAST(c_nationkey AS DOUBLE) / 4 AS load1, abs(c_acctbal) / 100 AS cpu_percent, c_nationkey AS completed, c_nationkey % 4 AS failed, c_nationkey % 6 AS cpu_cores FROM customer"


def _workers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    return load(spark, d, "customer").select(
        F.col("c_custkey").alias("worker_id"), F.when(F.col("c_acctbal") > 0, "alive").otherwise("dead").alias("status"), (n % 5).alias("running"), (n % 3).alias("queued"),
        (n.cast("double") / 4).alias("load1"), (F.abs("c_acctbal") / 100).alias("cpu_percent"), n.alias("completed"), (n % 4).alias("failed"), (n % 6).alias("cpu_cores"),
    )


@query(
    f"""WITH m AS (SELECT user_id AS worker_id, {mean('value')} AS cpu, {mean('(value / 10)')} AS load FROM events GROUP BY user_id)
    SELECT count(*) FILTER (status = 'alive') AS alive, count(*) AS total, {mean('cpu')} AS mean_cpu, {mean('load')} AS mean_load, CAST(coalesce(sum(completed), 0) AS BIGINT) AS completed, CAST(coalesce(sum(failed), 0) AS BIGINT) AS failed
    FROM ({WORKERS}) w LEFT JOIN m USING (worker_id)"""
)
def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    samples = _beats(spark, d).select("worker_id", F.col("value").alias("cpu_percent"), (F.col("value") / 10).alias("load1"))
    return metrics.cluster_metrics(_workers(spark, d).select("worker_id", "status", "completed", "failed"), samples)


STAGED = f"SELECT o_custkey AS job_id, o_orderpriority AS stage, {STATE} AS status FROM orders"


def _staged(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return load(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("stage"), F.when(s == "F", "SUCCEEDED").when(s == "O", "RUNNING").otherwise(s).alias("status"), F.col("o_totalprice").alias("elapsed"), F.lit(False).alias("speculated"))


JOB_STATES = ("PENDING", "SHARDING", "MAP", "SHUFFLE", "REDUCE", "SUCCEEDED", "FAILED", "CANCELLED")


def state_sql(states: tuple[str, ...]) -> str:
    return f"['{"', '".join(states)}'][1 + CAST((o_orderkey * 7 + o_custkey) % {len(states)} AS INTEGER)]"


def _in_states(spark: SparkSession, d: str, states: tuple[str, ...]) -> DataFrame:
    """Orders as tasks or jobs that are in all states."""
    at = ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % len(states) + 1).cast("int")
    state = F.element_at(F.array(*[F.lit(x) for x in states]), at)
    return load(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("stage"), state.alias("status"))


TASK_ROWS = f"SELECT o_custkey AS job_id, o_orderpriority AS stage, {state_sql(metrics.TASK_STATES)} AS status FROM orders"
JOB_ROWS = f"SELECT {state_sql(JOB_STATES)} AS status FROM orders"
TASK_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s.lower()}" for s in metrics.TASK_STATES)


@query(
    f"""SELECT stage, count(*) AS total, count(*) FILTER (status = 'SUCCEEDED') AS done, {TASK_COUNTS},
    floor(count(*) FILTER (status = 'SUCCEEDED') / count(*) * 100 * 10 + 0.5) / 10 AS pct FROM ({TASK_ROWS}) GROUP BY stage"""
)
def stage_progress(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stage_progress(_in_states(spark, d, metrics.TASK_STATES))


@query(f"SELECT status, count(*) AS count FROM ({TASK_ROWS}) GROUP BY status")
def job_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.status_histogram(_in_states(spark, d, metrics.TASK_STATES))


@query(f"SELECT job_id, count(*) AS total, {TASK_COUNTS} FROM ({TASK_ROWS}) GROUP BY job_id")
def job_summaries(spark: SparkSession, d: str) -> DataFrame:
    return metrics.job_summary(_in_states(spark, d, metrics.TASK_STATES))


ACTIVE = ", ".join(f"'{s}'" for s in metrics.JOB_ACTIVE)


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (status IN ({ACTIVE})) AS active, count(*) FILTER (status = 'SUCCEEDED') AS succeeded,
    count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'CANCELLED') AS cancelled FROM ({JOB_ROWS})"""
)
def overview(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overview(_in_states(spark, d, JOB_STATES))


@query(
    f"""WITH m AS (SELECT user_id AS worker_id, {mean('value')} AS cpu, {mean('(value / 10)')} AS load FROM events GROUP BY user_id)
    SELECT worker_id, status, completed, failed, cpu, load FROM ({WORKERS}) w LEFT JOIN m USING (worker_id)"""
)
def worker_metrics(spark: SparkSession, d: str) -> DataFrame:
    samples = _beats(spark, d).select("worker_id", F.col("value").alias("cpu_percent"), (F.col("value") / 10).alias("load1"))
    return metrics.worker_metrics(_workers(spark, d).select("worker_id", "status", "completed", "failed"), samples)


def newest_rows(table: str, key: str, n: int) -> str:
    rank = f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY ts_ms DESC, sample_id DESC) AS INTEGER)"
    return f"SELECT * FROM (SELECT *, {rank} AS rank FROM ({table})) WHERE rank <= {n}"


@query(newest_rows("SELECT user_id AS worker_id, event_id AS sample_id, (epoch_us(ts) // 1000) AS ts_ms, value AS cpu_percent FROM events", "worker_id", 300))
def worker_series_long(spark: SparkSession, d: str) -> DataFrame:
    return metrics.last_samples(_beats(spark, d).withColumnsRenamed({"value": "cpu_percent", "event_id": "sample_id"}), "worker_id", 300, "sample_id")


@query(newest_rows("SELECT event_type AS job_id, event_id AS sample_id, (epoch_us(ts) // 1000) AS ts_ms, value AS records_per_sec FROM events", "job_id", 300))
def job_recent_samples(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("event_type").alias("job_id"), F.col("event_id").alias("sample_id"), scalars.epoch_ms(F.col("ts")).alias("ts_ms"), F.col("value").alias("records_per_sec"))
    return metrics.last_samples(e, "job_id", 300, "sample_id")


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'alive') AS alive, count(*) FILTER (status = 'dead') AS dead, string_agg(worker_id, ',' ORDER BY worker_id) AS workers FROM ({WORKERS})")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.registry_summary(_workers(spark, d)).withColumn("workers", F.array_join(F.col("workers").cast("array<string>"), ","))


@query(
    """SELECT o_custkey AS job_id, CAST(coalesce(sum(o_orderkey) FILTER (o_orderkey % 3 <> 0), 0) AS BIGINT) AS map_processed, count(*) FILTER (o_orderkey % 3 <> 0) AS map_emitted,
    CAST(coalesce(sum(o_orderkey) FILTER (o_orderkey % 3 = 0), 0) AS BIGINT) AS reduce_processed, count(*) FILTER (o_orderkey % 3 = 0) AS reduce_emitted, CAST(sum(o_orderkey % 4 + 1) AS BIGINT) AS attempts FROM orders GROUP BY o_custkey"""
)
def job_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return metrics.job_totals(load(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.when(k % 3 == 0, "reduce").otherwise("map").alias("kind"), k.alias("processed"), F.lit(1).alias("emitted"), (k % 4 + 1).alias("attempts")))


@query(
    """SELECT worker_id, ts_ms, busy, total, mem_used, mem_total, CASE WHEN total - lag(total) OVER w > 0 THEN floor((busy - lag(busy) OVER w) / (total - lag(total) OVER w) * 100 * 100 + 0.5) / 100 ELSE 0.0 END AS cpu_percent,
    floor(mem_used / mem_total * 100 * 100 + 0.5) / 100 AS mem_percent FROM (SELECT user_id AS worker_id, event_id AS ts_ms, event_id * 3 AS busy, event_id * 7 AS total, event_id % 64 AS mem_used, 64 AS mem_total FROM events) WINDOW w AS (PARTITION BY worker_id ORDER BY ts_ms)"""
)
def resource_samples(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return metrics.resource_samples(load(spark, d, "events").select(F.col("user_id").alias("worker_id"), e.alias("ts_ms"), (e * 3).alias("busy"), (e * 7).alias("total"), (e % 64).alias("mem_used"), F.lit(64).alias("mem_total")))


# Scheduling and faults -----------------------------------------------------------------------------------------------


@query(
    """WITH done AS (SELECT o_custkey, median(o_totalprice) AS median FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 GROUP BY o_custkey HAVING count(*) >= 2)
    SELECT o_custkey AS job_id, o_orderkey AS task_id, o_totalprice AS elapsed, median FROM orders JOIN done USING (o_custkey) WHERE o_orderstatus = 'O' AND o_totalprice > median * 2"""
)
def stragglers(spark: SparkSession, d: str) -> DataFrame:
    return faults.stragglers(_staged(spark, d))


#: The end of January 2024, when the events end; heartbeats are 80 minutes apart at most there.
NOW_MS, TIMEOUT_MS = 1706659200000, 80 * 60 * 1000


@query(f"SELECT user_id AS worker_id, max((epoch_us(ts) // 1000)) AS last_ms, CASE WHEN {NOW_MS} - max((epoch_us(ts) // 1000)) > {TIMEOUT_MS} THEN 'dead' ELSE 'alive' END AS status FROM events GROUP BY user_id")
def liveness(spark: SparkSession, d: str) -> DataFrame:
    return faults.liveness(_beats(spark, d), F.lit(NOW_MS), TIMEOUT_MS)


@query(f"SELECT *, running * 1.0::DOUBLE + queued * 0.5::DOUBLE + load1 * 0.25::DOUBLE + cpu_percent * 0.01::DOUBLE AS score FROM ({WORKERS}) WHERE status = 'alive'")
def least_loaded(spark: SparkSession, d: str) -> DataFrame:
    return faults.least_loaded(_workers(spark, d))


@query(f"SELECT worker_id FROM ({WORKERS}) WHERE status = 'alive' AND worker_id NOT IN (0, 1) ORDER BY load1 * 2 + cpu_percent * 0.01::DOUBLE, worker_id LIMIT 1")
def chosen_worker(spark: SparkSession, d: str) -> DataFrame:
    return faults.choose_worker(_workers(spark, d), [0, 1])


@query(
    f"""WITH r AS (SELECT o_custkey AS worker_id, count(*) AS running FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT worker_id, CAST(greatest(1, least(CASE WHEN cpu_cores > 0 THEN cpu_cores ELSE 2 END, 3)) AS INTEGER) AS capacity, coalesce(r.running, 0) AS running, greatest(1, least(CASE WHEN cpu_cores > 0 THEN cpu_cores ELSE 2 END, 3)) - coalesce(r.running, 0) AS free
    FROM ({WORKERS}) w LEFT JOIN r USING (worker_id) WHERE status = 'alive' AND greatest(1, least(CASE WHEN cpu_cores > 0 THEN cpu_cores ELSE 2 END, 3)) > coalesce(r.running, 0)"""
)
def worker_slots(spark: SparkSession, d: str) -> DataFrame:
    tasks = _staged(spark, d).select(F.col("job_id").alias("worker_id"), "status")
    return faults.free_slots(_workers(spark, d).select("worker_id", "status", "cpu_cores"), tasks)


@query("SELECT o_orderkey AS task_id, o_orderkey % 5 AS attempts, CASE WHEN o_orderkey % 5 < 3 THEN 'RETRYING' ELSE 'FAILED' END AS next_status, CASE WHEN o_orderkey % 5 < 3 THEN CAST(1000 * pow(2, o_orderkey % 5) AS BIGINT) END AS delay_ms FROM orders WHERE o_orderstatus = 'P'")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_orderstatus = 'P'")
    return faults.retries(o.select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 5).alias("attempts")), 3, 1000)


@query("SELECT o_custkey AS worker_id, o_orderkey AS task_id, 'RETRYING' AS status FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal <= 0)")
def dead_worker_tasks(spark: SparkSession, d: str) -> DataFrame:
    tasks = _staged(spark, d).select(F.col("job_id").alias("worker_id"), "task_id", "status")
    return faults.reassigned(tasks, _workers(spark, d).where("status = 'dead'"))


FAULTS = "SELECT event_id AS fault_id, event_type AS kind, (epoch_us(ts) // 1000) AS created_ms FROM events"


def _faults(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_id").alias("fault_id"), F.col("event_type").alias("kind"), scalars.epoch_ms(F.col("ts")).alias("created_ms"))


@query(FAULTS)
def fault_list(spark: SparkSession, d: str) -> DataFrame:
    return faults.newest_faults(_faults(spark, d))


@query(f"SELECT kind, count(*) AS count FROM ({FAULTS}) GROUP BY kind")
def fault_counts(spark: SparkSession, d: str) -> DataFrame:
    return faults.fault_counts(_faults(spark, d))


@query("SELECT o_orderkey AS id, o_orderkey % 3 AS if_version, coalesce(CAST(c_nationkey % 3 AS BIGINT), 0) AS stored_version FROM orders LEFT JOIN customer ON c_custkey = o_orderkey WHERE o_orderkey % 3 <> coalesce(c_nationkey % 3, 0)")
def version_conflicts(spark: SparkSession, d: str) -> DataFrame:
    updates = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("if_version"))
    return faults.conflicts(updates, load(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("version")))


@query("SELECT o_orderkey AS id, CAST(greatest(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, 0) + 1, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END, 0)) AS BIGINT) AS version FROM orders")
def version_bump(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(k.alias("id"), faults.bumped(F.when(k % 2 == 0, F.col("o_custkey")), F.when(k % 3 == 0, k)).alias("version"))


# Scalars -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE CAST(CAST(event_id AS DOUBLE) AS VARCHAR) END AS v FROM events")
def sanitized(spark: SparkSession, d: str) -> DataFrame:
    e, k = load(spark, d, "events"), F.col("event_id")
    v = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 2, float("-inf")).otherwise(k.cast("double"))
    return e.select("event_id", scalars.sanitize(v).alias("v"))


@query("SELECT event_id, greatest(5.0::DOUBLE, least(100.0::DOUBLE, coalesce(TRY_CAST(raw AS DOUBLE), 8.0::DOUBLE))) AS number, raw IN ('true', '1') AS flag FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'x' WHEN 2 THEN '1' ELSE CAST(event_id AS VARCHAR) END AS raw FROM events)")
def clamped(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, "true").when(k % 4 == 1, "x").when(k % 4 == 2, "1").otherwise(k.cast("string"))
    return load(spark, d, "events").select("event_id", scalars.clamp_number(raw, 8, 5, 100).alias("number"), scalars.to_flag(raw).alias("flag"))


@query("SELECT o_orderkey, 'm-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS task_id, CAST(o_orderkey % 10000 AS INTEGER) AS index, 'part-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '.jsonl' AS file, CAST(o_custkey % 10000 AS INTEGER) AS file_index FROM orders")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", scalars.padded_id("m", F.col("o_orderkey") % 10000).alias("task_id"), scalars.partition_file(F.col("o_custkey") % 10000).alias("file"))
    return o.select("o_orderkey", "task_id", scalars.index_of(F.col("task_id")).alias("index"), "file", scalars.partition_index(F.col("file")).alias("file_index"))


@query(f"SELECT event_id, CAST(greatest(0, {NOW_MS} - (epoch_us(ts) // 1000)) AS BIGINT) AS ms FROM events")
def elapsed(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", scalars.elapsed_ms(F.lit(NOW_MS), scalars.epoch_ms(F.col("ts"))).alias("ms"))


@query("SELECT event_type, " + mean("v") + " AS mean FROM (SELECT event_type, CASE WHEN event_type <> 'view' THEN value END AS v FROM events) GROUP BY event_type")
def means(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_type") != "view", F.col("value"))
    return load(spark, d, "events").groupBy("event_type").agg(scalars.mean_or_zero(v).alias("mean"))


# Generated input -----------------------------------------------------------------------------------------------------


@query(name="synthetic_wordcount")
def _synthetic_wordcount(spark: SparkSession, d: str) -> DataFrame:
    p = jobs.preset("term frequency")
    return jobs.run_job(synthetic_text(spark, p.input_rows, 7), p.mapper, p.reducer)


@query(name="synthetic_key_value")
def _synthetic_key_value(spark: SparkSession, d: str) -> DataFrame:
    p = jobs.preset("key-value sums")
    return jobs.run_job(synthetic_pairs(spark, p.input_rows, 7), p.mapper, p.reducer)


@query("SELECT CAST(15000 AS BIGINT) AS records, CAST(6 AS BIGINT) AS keys, CAST(1000 AS BIGINT) AS at_most, CAST(1 AS BIGINT) AS at_least, CAST(12000 AS BIGINT) AS lines, CAST(5 AS INTEGER) AS fewest, CAST(12 AS INTEGER) AS most")
def synthetic_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the generated input whatever the seed: its sizes, keys, values and line lengths."""
    pairs, text = synthetic_pairs(spark, jobs.preset("key-value sums").input_rows, 7), synthetic_text(spark, jobs.preset("term frequency").input_rows, 7)
    a = pairs.agg(F.count("*").alias("records"), F.count_distinct("key").alias("keys"), F.max("value").alias("at_most"), F.min("value").alias("at_least"))
    n = F.size(F.split("text", " "))
    return a.crossJoin(text.agg(F.count("*").alias("lines"), F.min(n).alias("fewest"), F.max(n).alias("most")))
