"""Sources: Parquet tables, JSON documents, JSON lines, folders, and seeded generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The words and keys of generated records; "partition" is drawn twice as often.
WORDS = (
    "map", "reduce", "shuffle", "shard", "worker", "master", "cluster", "distributed", "task", "partition", "sort", "merge", "node", "fault", "retry", "heartbeat",
    "scheduler", "load", "balance", "throughput", "latency", "memory", "cpu", "network", "storage", "json", "atomic", "log", "metric", "recover", "coordinate",
    "parallel", "stream", "batch", "spill", "partition", "key", "value", "record", "stage", "job", "input", "output", "result", "error", "timeout", "progress",
    "monitor", "submit",
)
KEYS = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One document a file; a corrupt one gives a row of nulls, a missing or empty folder no row."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One record a line; blank and malformed lines are skipped."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path))


def _or_empty(spark: SparkSession, schema: StructType | str, read) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def list_files(spark: SparkSession, path: str, suffix: str = "", recursive: bool = True) -> DataFrame:
    """path, name, bytes of the files in a folder, sorted, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes")).orderBy("path")


def seed_of(name: str, base: int = 0) -> int:
    return (base + sum(map(ord, name))) % ((1 << 31) - 1)


def synthetic_text(spark: SparkSession, rows: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Exactly `rows` lines (text) of 5 to 12 words; the same rows for the same seed, however dealt."""
    pool = F.array(*[F.lit(w) for w in WORDS])
    n = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(-1)), F.lit(8)) + 5).cast("int")
    word = lambda i: F.element_at(pool, (F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(len(WORDS))) + 1).cast("int"))
    return spark.range(0, rows, 1, partitions).select(F.array_join(F.transform(F.sequence(F.lit(1), n), word), " ").alias("text"))


def synthetic_pairs(spark: SparkSession, rows: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Exactly `rows` records (key, value): six keys, values 1 to 1000."""
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit("k")), F.lit(len(KEYS))) + 1).cast("int"))
    return spark.range(0, rows, 1, partitions).select(key.alias("key"), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit("v")), F.lit(1000)) + 1).alias("value"))


def generate(spark: SparkSession, kind: str, rows: int, seed: int = 0) -> DataFrame:
    return synthetic_pairs(spark, rows, seed) if kind == "kv" else synthetic_text(spark, rows, seed)
