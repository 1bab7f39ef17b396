"""Helpers shared by the corpus operators: shared work folders, cut points, Arrow batch access and media-safe file I/O."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401  pa.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; whole texts are carried, so batches stay small.
BATCH_ROWS = 256
#: Bytes of one Arrow batch, where Spark knows that limit.
BATCH_BYTES = 4 << 20
#: The words of every contract here: runs without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: a batch of documents is rows of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Work folders of this process that still hold something.
FOLDERS: list[str] = []


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local master may do without that setting, as in tests on one machine:
    it gets a temporary folder of this process, which goes with it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tessera.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("tessera.work.dir", base)
    FOLDERS.append(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    return FOLDERS[-1]


def discard(*folders: str | DataFrame) -> None:
    """Delete work folders, given by path or by the table that `cut` read from them, which nothing will read any more."""
    for f in folders:
        path = f if isinstance(f, str) else f.__dict__.get("work_folder")
        if path in FOLDERS:
            FOLDERS.remove(path)
            store, folder = open_store(path)
            if store.get_file_info(folder).type != pa.fs.FileType.NotFound:
                store.delete_dir(folder)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = work_dir(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_folder = path
    return out


def binary_list(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """name, or a variant of it that clashes with no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def as_long(c: str) -> Column:
    return F.col(c).cast("long").alias(c)


def open_store(uri: str):
    """(filesystem, path) of a URI, for tasks: local, HDFS or an object store through Arrow."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends blobs to shard files of bounded size under a shared folder.

    Names hold a random id for each attempt of a task, so a repeated attempt never touches another's file; only what
    the task's committed rows refer to counts, and the rest is unreferenced waste.
    """

    def __init__(self, root: str, suffix: str, max_bytes: int, tail: bytes = b""):
        self.store, self.root = open_store(root)
        self.store.create_dir(self.root, recursive=True)
        self.suffix, self.max_bytes, self.tail = suffix, max_bytes, tail
        self.stream, self.name, self.at = None, "", 0

    def room(self, n: int) -> bool:
        """Open a new shard if n more bytes don't fit; true if one was opened."""
        if self.stream is not None and self.at + n <= self.max_bytes:
            return False
        self.close()
        self.name = f"{uuid.uuid4().hex}{self.suffix}"
        self.stream, self.at = self.store.open_output_stream(os.path.join(self.root, self.name), compression=None), 0
        return True

    def put(self, blob: bytes) -> int:
        at = self.at
        self.stream.write(blob)
        self.at += len(blob)
        return at

    def close(self) -> None:
        if self.stream is not None:
            if self.tail:
                self.stream.write(self.tail)
            self.stream.close()
            self.stream = None


class ShardReader:
    """Range reads of shard files under a shared folder; keeps few files open."""

    def __init__(self, root: str, keep: int = 8):
        self.store, self.root = open_store(root)
        self.keep, self.files = keep, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.files.pop(name, None) or self.store.open_input_file(os.path.join(self.root, name))
        self.files[name] = f
        if len(self.files) > self.keep:
            self.files.pop(next(iter(self.files))).close()
        return f.read_at(length, offset)

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def record_stream(it: Iterator[pa.RecordBatch], one, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """one(batch) -> dict of lists, as batches of schema."""
    for b in it:
        if b.num_rows:
            yield batches(one(b), schema)
