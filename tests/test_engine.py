"""Operators against plain-Python restatements on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tessera.functions import mappers, scalars
from tessera.operators import config, faults, jobs, logs, metrics, partitioning, reducers, results
from tessera.plans import queries as plans
from tessera.sources import tables
from tessera.streaming.heartbeats import windowed_beats

TEXTS = ["The map, the MAP; reduce", None, "", "  ", "été café naïve", "分布式 map 系统", "a-b_c 42 a", "the"]


def words(text):
    return [w for w in re.split("[^a-zA-Z0-9一-鿿]+", (text or "").lower()) if w]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "text string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_text_mappers(texts):
    pairs = [(w, 1) for t in TEXTS for w in words(t)]
    assert rows(mappers.wordcount(texts)) == sorted(pairs)
    assert rows(mappers.word_length(texts)) == sorted((w, len(w)) for w, _ in pairs)
    assert rows(mappers.distinct(texts)) == sorted((w, 1) for t in TEXTS for w in set(words(t)))


@pytest.mark.parametrize("pattern", ["MAP", "e", "", "%", "zzz", "."])
def test_grep_is_literal_and_has_no_row_without_match(texts, pattern):
    n = sum(pattern.lower() in (t or "").lower() for t in TEXTS)
    got = rows(reducers.count(mappers.grep(texts, pattern=pattern)))
    assert got == ([(pattern.lower(), n)] if n else [])


def test_kv_values(spark):
    given = [("a", "12"), ("a", " 12 "), (None, "1e3"), ("b", "abc"), ("b", None), ("b", "12d"), ("c", "nan"), ("c", "2"), ("e", "inf")]
    df = spark.createDataFrame(given, "key string, value string")
    assert rows(reducers.stats(mappers.kv(df))) == [("a", 2, 24.0, 12.0), ("b", 3, 0.0, 0.0), ("c", 2, 2.0, 1.0), ("e", 1, float("inf"), float("inf")), ("unknown", 1, 1000.0, 1000.0)]
    numbers = spark.createDataFrame([("a", 1.005), ("a", -2.5), (None, float("nan"))], "key string, value double")
    assert rows(reducers.total(mappers.kv(numbers)))[0] == ("a", 2, -1.495, -0.748)


def test_reducers_and_hot_keys(spark):
    df = spark.createDataFrame([("hot", i % 7) for i in range(5000)] + [("k", 3)], "key string, value long")
    total = sum(i % 7 for i in range(5000))
    assert rows(reducers.count(df)) == [("hot", total), ("k", 3)]
    assert rows(reducers.extremes(df), "key", "count", "min", "max") == [("hot", 5000, 0, 6), ("k", 1, 3, 3)]
    plan = reducers.count(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_all_pairs_of_names(spark, texts):
    pairs = tables.synthetic_pairs(spark, 50)
    for m in ("wordcount_mapper", "word_length_mapper", "grep_mapper", "kv_mapper", "distinct_mapper"):
        for r in ("count_reducer", "stats_reducer", "sum_reducer"):
            assert jobs.run_job(pairs if m == "kv_mapper" else texts, m, r).columns[0] == "key"


def test_registry():
    with pytest.raises(KeyError, match="wordcount_mapper"):
        jobs.MAPPERS.get("nope")
    with pytest.raises(KeyError):
        jobs.Job("x", "nope")
    with pytest.raises(ValueError):
        jobs.Job("x", "grep_mapper", num_reduce_tasks=0)
    assert jobs.Job("x", "grep_mapper", num_map_tasks=100, input_rows=30).map_tasks == 30
    assert [j.input_rows for j in jobs.PRESETS.values()] == [12_000, 12_000, 8_000, 15_000, 6_000]
    assert jobs.input_kind("kv_mapper") == "kv" and jobs.input_kind("other") == "wordcount"
    assert {x["name"] for x in jobs.REDUCERS.listing()} >= {"count_reducer", "stats_reducer", "sum_reducer"}
    with pytest.raises(KeyError):
        jobs.preset("none")


def test_own_functions(spark, texts):
    jobs.MAPPERS.register("letters_mapper", lambda df, **_: df.select(F.explode(F.split("text", "")).alias("key"), F.lit(1).alias("value")), "each letter")
    jobs.REDUCERS.register("pandas_reducer", lambda df: df.groupBy("key").applyInPandas(lambda p: p.groupby("key", as_index=False).agg(n=("value", "sum")), "key string, n long"))
    try:
        got = dict(rows(jobs.run_job(texts.where("text = 'the'"), "letters_mapper", "pandas_reducer")))
        assert {k: v for k, v in got.items() if k} == {"t": 1, "h": 1, "e": 1}
    finally:
        del jobs.MAPPERS.functions["letters_mapper"], jobs.REDUCERS.functions["pandas_reducer"]


def test_partition_hash(spark):
    keys = ["the", "key", "word", "", "é"] + [f"k{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    for n in (1, 4, 7, 8):
        got = dict(rows(df.select("key", partitioning.partition_of(F.col("key"), n).alias("p"))))
        for k in keys:
            want = int.from_bytes(hashlib.md5((partitioning.SALT + k).encode()).digest()[:8], "big") % n
            assert got[k] == want and 0 <= got[k] < n


@pytest.mark.parametrize(("n", "parts", "sizes"), [(10, 3, [4, 3, 3]), (11, 4, [3, 3, 3, 2]), (2, 10, [1, 1]), (0, 4, []), (7, 7, [1] * 7)])
def test_even_split(spark, n, parts, sizes):
    got = partitioning.split_evenly(spark.range(n), parts, "id").orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(n))
    assert [c for _, c in sorted(Counter(r["part"] for r in got).items())] == sizes
    assert [r["part"] for r in got] == sorted(r["part"] for r in got)


@pytest.mark.parametrize("parts", [7, 64])
def test_even_split_of_many_rows_with_several_columns(spark, parts):
    n = 1_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), "id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    got = partitioning.split_evenly(df, parts, "k").groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_distinct("id").alias("ids")).orderBy("part").collect()
    assert [r["n"] for r in got] == [n // parts + (i < n % parts) for i in range(parts)] == [r["ids"] for r in got]
    assert all(a["high"] < b["low"] for a, b in zip(got[:-1], got[1:], strict=True))


def test_results_are_stored_by_partition(spark, tmp_path):
    df = reducers.count(mappers.wordcount(spark.createDataFrame([(t,) for t in TEXTS], "text string")))
    results.store_results(df, f"{tmp_path}/out", 4)
    got = results.read_results(spark, f"{tmp_path}/out", "key string, count long").collect()
    want = {r["key"]: (r["count"], r["p"]) for r in df.withColumn("p", partitioning.partition_of(F.col("key"), 4)).collect()}
    assert {r["key"]: (r["count"], r["partition"]) for r in got} == want
    assert [(r["partition"], r["key"]) for r in got] == sorted((p, k) for k, (_, p) in want.items())


def test_partition_sizes(spark):
    pairs = [("a", 1), ('q"\\', 22), ("é", 3)]
    got = partitioning.partition_sizes(spark.createDataFrame(pairs, "key string, value long"), 1).collect()[0]
    import json

    assert (got["records"], got["bytes"]) == (3, sum(len(json.dumps(list(p), ensure_ascii=False).encode()) + 1 for p in pairs))


def test_partition_sizes_of_repeated_keys(spark):
    pairs = [("a", 1), ("a", 22), ("a", 22), ("a", None), ('q"\\\n', -5), ("é", 3), ("b", None)] + [("分布式", i) for i in range(300)] + [(f"k{i % 40}", i) for i in range(500)]
    import json

    want = defaultdict(lambda: [0, None])
    for k, v in pairs:
        cell = want[int.from_bytes(hashlib.md5((partitioning.SALT + k).encode()).digest()[:8], "big") % 4]
        cell[0] += 1
        if v is not None:
            cell[1] = (cell[1] or 0) + len(json.dumps([k, v], ensure_ascii=False).encode()) + 1
    df = partitioning.partition_sizes(spark.createDataFrame(pairs, "key string, value long"), 4)
    assert rows(df, "partition", "records", "bytes") == sorted((p, n, b) for p, (n, b) in want.items())


def test_partition_sizes_hashes_and_quotes_each_key_once(spark, texts):
    plan = partitioning.partition_sizes(mappers.wordcount(texts), 8)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    by_key = max((i for i, line in enumerate(plan) if "Aggregate [key#" in line), default=-1)
    counted, each_row = "".join(plan[: by_key + 1]), "".join(plan[by_key + 1 :])
    assert "md5" in counted and "StructsToJson" in counted
    assert "md5" not in each_row and "StructsToJson" not in each_row


def test_listed_separators_are_all_others(spark):
    separates = lambda pattern: F.regexp_replace("c", pattern, "") == ""
    points = spark.createDataFrame([(chr(i),) for i in range(0x110000) if not 0xD800 <= i < 0xE000], "c string")
    assert points.where(separates(mappers.SEPARATORS) != separates(mappers.LISTED_SEPARATORS)).count() == 0
    assert points.where(~separates(mappers.LISTED_SEPARATORS)).count() == 26 * 2 + 10 + 0x9FFF - 0x4E00 + 1


def test_pages_and_merges(spark):
    df = spark.range(25).withColumnRenamed("id", "key")
    p = results.page(df, "key", limit=10).collect()
    assert [r["key"] for r in p] == list(range(10)) and {(r["total"], r["truncated"]) for r in p} == {(25, True)}
    assert {r["truncated"] for r in results.page(df, "key", limit=25).collect()} == {False}
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("b", 2), ("a", 1)], [("c", 3)]))
    assert [r["k"] for r in results.merge_sorted([a, b], "k").collect()] == ["a", "b", "c"]
    assert [r["k"] for r in results.merge_sorted([a, b], "k", descending=True).collect()] == ["c", "b", "a"]
    fold = results.fold_documents(spark.createDataFrame([("x", 2, 5), ("x", 1, 3)], "id string, o int, v int"), "id", "o", "v", F.lit(0), lambda acc, v: acc * 10 + v)
    assert rows(fold) == [("x", 35)]


def test_exports_and_scans(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "key string, count long, avg double")
    results.export_csv(df, f"{tmp_path}/csv")
    assert rows(spark.read.option("header", True).csv(f"{tmp_path}/csv"), "key", "count") == [("a", "1"), ("b", "2")]
    results.export_json(df, f"{tmp_path}/json")
    results.append_jsonl(df, f"{tmp_path}/json")
    assert tables.json_lines(spark, f"{tmp_path}/json", df.schema).count() == 4
    results.write_documents(df, f"{tmp_path}/docs")
    results.write_documents(df.limit(1), f"{tmp_path}/docs")
    assert spark.read.parquet(f"{tmp_path}/docs").count() == 1
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "part-0001.jsonl").write_text('{"key":"x","value":1}\n\n{ not json\n{"key":"y","value":2}\n')
    assert rows(tables.json_lines(spark, f"{tmp_path}/lines", "key string, value int")) == [("x", 1), ("y", 2)]
    assert tables.json_lines(spark, f"{tmp_path}/missing", "key string").count() == 0
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "good.json").write_text('{\n "x": 1\n}')
    (tmp_path / "one" / "bad.json").write_text("{ not json")
    assert Counter(r["x"] for r in tables.json_documents(spark, f"{tmp_path}/one", "x int").collect()) == {1: 1, None: 1}
    assert [r["name"] for r in tables.list_files(spark, str(tmp_path / "lines"), ".jsonl").collect()] == ["part-0001.jsonl"]


def test_log_search(spark, tmp_path):
    data = [(i, ("INFO", "ERROR")[i % 2], ("map", "reduce")[i % 3 == 0], f"m-{i % 4}", f"w{i % 2}", f"Message {i}" if i != 4 else None) for i in range(20)]
    df = spark.createDataFrame(data, "ts long, level string, stage string, task_id string, worker_id string, message string")
    got = logs.search(df, "MESSAGE 1", level="ERROR", limit=3).collect()
    assert [r["ts"] for r in got] == [15, 17, 19] and {r["total"] for r in got} == {6}
    assert logs.search(df, "w1", stage="map").count() == sum(r[2] == "map" and r[4] == "w1" for r in data)
    assert logs.scanned(df, stage="reduce").first()[0] == 7
    assert rows(logs.stages(df)) == [("map",), ("reduce",)]
    logs.write_log(df, f"{tmp_path}/logs")
    stored = spark.read.json(f"{tmp_path}/logs")
    plan = stored.where("stage = 'map' and task_id = 'm-1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stage" in plan
    assert logs.search(stored, task_id="m-1").count() == 5


def test_metrics(spark):
    s = spark.createDataFrame([("j", 10, 5, 0), ("j", 10, 5, 2000), ("k", 0, 0, 1000)], "job_id string, processed long, emitted long, duration_ms long")
    got = {r["job_id"]: r for r in metrics.job_metrics(metrics.task_samples(s)).collect()}
    assert (got["j"]["count"], got["j"]["total_processed"], got["j"]["peak_rate"], got["j"]["mean_latency_ms"]) == (2, 20, 10 / 1e-6, 1000.0)
    assert (got["k"]["mean_rate"], got["k"]["peak_rate"]) == (0.0, 0.0)
    w = spark.createDataFrame([("a", "alive", 3, 1), ("b", "dead", 4, 0), ("c", "alive", None, None)], "worker_id string, status string, completed int, failed int")
    x = spark.createDataFrame([("a", 10.0, 1.0), ("a", 30.0, 3.0), ("b", 100.0, 0.0)], "worker_id string, cpu_percent double, load1 double")
    assert metrics.cluster_metrics(w, x).collect()[0].asDict() == {"alive": 2, "total": 3, "mean_cpu": 60.0, "mean_load": 1.0, "completed": 7, "failed": 1}
    t = spark.createDataFrame([("map", "SUCCEEDED"), ("map", "RUNNING"), ("map", "FAILED")], "stage string, status string")
    p = metrics.stage_progress(t).collect()[0]
    assert (p["total"], p["done"], p["pct"], p["n_running"], p["n_pending"]) == (3, 1, 33.3, 1, 0)
    assert metrics.histogram_map(t, "status").first()[0] == {"FAILED": 1, "RUNNING": 1, "SUCCEEDED": 1}
    r = spark.createDataFrame([("a", 1, 10, 100, 5, 10), ("a", 2, 30, 150, 5, 10)], "worker_id string, ts_ms long, busy long, total long, mem_used long, mem_total long")
    assert [(x["cpu_percent"], x["mem_percent"]) for x in metrics.resource_samples(r).orderBy("ts_ms").collect()] == [(0.0, 50.0), (40.0, 50.0)]


def test_faults(spark):
    t = spark.createDataFrame(
        [("j", "a", "SUCCEEDED", e, False) for e in (1000, 2000, 4000, 9000)] + [("j", "r1", "RUNNING", 6001, False), ("j", "r2", "RUNNING", 6000, False), ("j", "r3", "RUNNING", 9000, True), ("k", "x", "SUCCEEDED", 1, False), ("k", "y", "RUNNING", 99, False)],
        "job_id string, task_id string, status string, elapsed long, speculated boolean",
    )
    assert rows(faults.stragglers(t), "task_id", "median") == [("r1", 3000.0)]
    w = spark.createDataFrame([("a", "alive", 1, 0, 0.0, 0.0, 8), ("b", "alive", 0, 1, 0.0, 0.0, 0), ("c", "dead", 0, 0, 0.0, 0.0, 1)], "worker_id string, status string, running int, queued int, load1 double, cpu_percent double, cpu_cores int")
    assert [r["worker_id"] for r in faults.least_loaded(w).collect()] == ["b", "a"]
    assert faults.choose_worker(w).first()[0] == "a" and faults.choose_worker(w, ["a"]).first()[0] == "b" and faults.choose_worker(w, ["a", "b"]).first()[0] == "a"
    tasks = spark.createDataFrame([("a", "RUNNING"), ("a", "ASSIGNED"), ("b", "RUNNING"), ("b", "RETRYING"), ("c", "RUNNING")], "worker_id string, status string")
    assert rows(faults.free_slots(w, tasks), "worker_id", "capacity", "running", "free") == [("a", 3, 2, 1)]
    assert rows(faults.reassigned(tasks, w.where("status = 'dead'")), "worker_id", "status") == [("c", "RETRYING")]
    f = spark.createDataFrame([("t", 1), ("u", 3)], "task_id string, attempts int")
    assert rows(faults.retries(f, 3, 500), "task_id", "next_status", "delay_ms") == [("t", "RETRYING", 1000), ("u", "FAILED", None)]
    beats = spark.createDataFrame([("a", 0), ("a", 100), ("b", 10)], "worker_id string, ts_ms long")
    assert rows(faults.liveness(beats, F.lit(120), 50), "worker_id", "status") == [("a", "alive"), ("b", "dead")]
    stored = spark.createDataFrame([("d", 3)], "id string, version int")
    updates = spark.createDataFrame([("d", 3), ("d", 2), ("new", 0), ("new", 1)], "id string, if_version int")
    assert rows(faults.conflicts(updates, stored), "id", "if_version") == [("d", 2), ("new", 1)]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()[0]
    assert [value(scalars.sanitize(F.lit(float(x)))) for x in ("nan", "inf", "-inf", "1.5")] == [None, "inf", "-inf", "1.5"]
    assert [value(scalars.clamp_integer(F.lit(x), 5, 1, 10)) for x in ("7", "x", "99", "-3", None)] == [7, 5, 10, 1, 5]
    assert [value(scalars.to_flag(F.lit(x))) for x in ("1", "TRUE", " yes ", "on", "no", None)] == [True, True, True, True, False, False]
    assert [value(scalars.show_bytes(F.lit(x))) for x in (None, 5, 2048, 5 << 20, 3 << 30)] == ["-", "5 B", "2.0 KB", "5.00 MB", "3.00 GB"]
    assert [value(scalars.show_duration(F.lit(x))) for x in (None, 5, 1500, 90000)] == ["-", "5 ms", "1.5 s", "1.5 min"]
    assert value(scalars.show_percent(F.lit(12.34))) == "12.3%" and value(scalars.show_number(F.lit(1234567))) == "1,234,567"
    assert value(scalars.clock(F.lit(0))) == "-" and value(scalars.clock(F.lit(1704067200123))) == "2024-01-01 00:00:00"
    assert value(scalars.padded_id("m", F.lit(7))) == "m-0007" and value(scalars.index_of(F.lit("m-0007"))) == 7
    assert value(scalars.partition_index(scalars.partition_file(F.lit(3)))) == 3
    assert value(scalars.label(scalars.STATE_LABELS, F.lit("odd"))) == "odd"
    assert value(scalars.unique_id("job", F.lit(255), F.lit("a"))).startswith("job-ff-")
    assert value(faults.bumped(F.lit(3), F.lit(9))) == 9 and value(faults.bumped(F.lit(None).cast("int"), F.lit(None).cast("int"))) == 1
    assert value(scalars.elapsed_ms(F.lit(5), F.lit(9))) == 0
    assert value(scalars.round_half_up(F.lit(-2.5), 0)) == -3.0


def test_generators(spark):
    a = tables.synthetic_text(spark, 800, 7, partitions=3)
    assert a.count() == 800 and rows(a) == rows(tables.synthetic_text(spark, 800, 7, partitions=1)) != rows(tables.synthetic_text(spark, 800, 8))
    counted = dict(rows(jobs.run_job(a, "wordcount_mapper", "count_reducer")))
    want = Counter(w for (t,) in rows(a) for w in t.split())
    assert counted == want and set(counted) == set(tables.WORDS)
    assert all(5 <= len(t.split()) <= 12 for (t,) in rows(a))
    pairs = tables.generate(spark, "kv", 300, 1).collect()
    sums = defaultdict(float)
    for r in pairs:
        assert 1 <= r["value"] <= 1000
        sums[r["key"]] += r["value"]
    assert {r["key"]: r["sum"] for r in jobs.run_job(tables.generate(spark, "kv", 300, 1), "kv_mapper", "sum_reducer").collect()} == sums
    assert tables.generate(spark, "grep", 1).count() == 1 and tables.seed_of("ab", 1) == 1 + 97 + 98


def test_heartbeat_stream(spark, tmp_path):
    rows_ = spark.sql("select timestamp_ntz'2024-01-01 00:10:00' ts, 1L user_id, 2.0D value union all select timestamp_ntz'2024-01-01 03:00:00', 1, 1.0D")
    rows_.selectExpr("cast(ts as timestamp) ts", "user_id", "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(f"{tmp_path}/in")
    q = windowed_beats(stream).writeStream.outputMode("complete").format("memory").queryName("beats").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["beats"] for r in spark.table("beats").collect()) == [1, 1]


def test_python_functions(spark, texts):
    jobs.MAPPERS.register("py_mapper", jobs.python_mapper(lambda records, params: [(w, params["by"]) for r in records for w in (r["text"] or "").split()], "long"))
    jobs.REDUCERS.register("py_reducer", jobs.python_reducer(lambda key, values: {"key": key, "n": sum(values)}, "key string, n long"))
    try:
        want = Counter(w for t in TEXTS for w in (t or "").split())
        assert dict(rows(jobs.run_job(texts, "py_mapper", "py_reducer", by=2))) == {k: 2 * n for k, n in want.items()}
    finally:
        del jobs.MAPPERS.functions["py_mapper"], jobs.REDUCERS.functions["py_reducer"]


def test_config():
    c = config.EngineConfig().updated(max_attempts="7", speculation="off", straggler_threshold="nan", shuffle_partitions=-5, input_rows=1e12, unknown=1, seed=None)
    assert (c.max_attempts, c.speculation, c.straggler_threshold, c.shuffle_partitions, c.input_rows, c.seed) == (7, False, 2.0, 1, 10_000_000, 42)
    assert c.spark_settings()["spark.task.maxFailures"] == "7" and c.updated() == c


def test_sanitized_reads_all_events(spark, tmp_path):
    import duckdb

    ids = [7, 9_999_999, 10_000_000, 10_000_001, 10_000_002, 10_000_003, 12_345_678_903, 4_000_000_000_000_003]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = {i: (None, "inf", "-inf", duckdb.execute(f"SELECT CAST(CAST({i} AS DOUBLE) AS VARCHAR)").fetchone()[0])[i % 4] for i in ids}
    assert {r["event_id"]: r["v"] for r in plans.QUERIES["sanitized"](spark, str(tmp_path)).collect()} == want
