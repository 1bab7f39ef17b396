"""Media columns: texts as lossless 8-bit images in content-addressed tar shards.

A payload is the text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, seen as an 8-bit grey picture 64
wide and stored as PNG. Members of a tar shard are named by the SHA-256 of the stored form. Equal payloads are stored once:
of the documents with one text, that with the smallest doc_id writes it, the others are left out before any text
is read by Python. Rows carry digest, offset and length; a range read of the first 33 bytes of a member fills the
picture's metadata, and only a read of the whole member gives the payload. Each member is read once, whatever refers to it.

Defined results: a null text is an empty payload of 64 bytes 0; repeated rows refer to equal members; an empty table
gives an empty index and no shard; other columns of the documents are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ShardReader, ShardWriter, batches, binary_list, cut, small_batches, table, work_dir

WIDTH = 64
SHARD_BYTES = 256 << 20
#: Media bytes that one read task should get, about.
READ_BYTES = 32 << 20
#: Documents left out that are sent to every task, of about 50 bytes each.
BROADCAST_ROWS = 1 << 20
#: Length of PNG's signature and header chunk.
HEADER_BYTES = 33
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"

PLACES = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("shard", pa.string()), ("media_offset", pa.int64()), ("media_bytes", pa.int64())])
PLACES_DDL = "digest binary, n_bytes long, media_sha256 string, shard string, media_offset long, media_bytes long"


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH wide, of a payload of whole rows; every row has filter 0."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from a PNG's first HEADER_BYTES bytes."""
    if head[:8] != PNG_SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    """The samples of a picture written by encode_png."""
    width, height, _ = read_header(media[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while media[at + 4 : at + 8] != b"IEND":
        n = struct.unpack(">I", media[at : at + 4])[0]
        data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("a row filter that is not written here")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Average hash of the samples in 64 equal cells (16 hex digits), their mean and their entropy in bits."""
    x = np.frombuffer(payload, np.uint8)
    cells = np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.arange(WIDTH + 1) * len(x) // WIDTH]) / (len(x) // WIDTH)
    bits = np.packbits(cells > x.mean()).tobytes().hex()
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    return f"{bits}:{x.mean():.3f}:{-(p * np.log2(p)).sum():.4f}"


def store(texts: DataFrame, root: str) -> DataFrame:
    """Store every text of texts (digest, text) in tar shards under root; their places. One pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ShardWriter(root, ".tar", SHARD_BYTES, tail=bytes(1024))
        for b in it:
            rows: dict[str, list] = {f.name: [] for f in PLACES}
            for digest, text in zip(b.column(0).to_pylist(), binary_list(b.column(1)), strict=True):
                media = encode_png(pad(text))
                name = hashlib.sha256(media).hexdigest()
                info = tarfile.TarInfo(f"{name}.png")
                info.size = len(media)
                head = info.tobuf(tarfile.GNU_FORMAT)
                out.room(len(head) + len(media) + -len(media) % 512)
                at = out.put(head + media + bytes(-len(media) % 512)) + len(head)
                for k, v in zip(PLACES.names, (digest, len(text), name, out.name, at, len(media)), strict=True):
                    rows[k].append(v)
            yield batches(rows, PLACES)
        out.close()

    return texts.select("digest", "text").mapInArrow(run, PLACES_DDL)


def write_media(docs: DataFrame, root: str) -> DataFrame:
    """Store the texts of docs in tar shards under root, each different one once: doc_id and the place of each row's text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("writer"), F.count("*").alias("n")).where("n > 1").select("digest", "writer")
    others = cut(rows.select("doc_id", "digest").join(several, "digest").where(~F.col("doc_id").eqNullSafe(F.col("writer"))).select(F.col("digest").alias("o_digest"), F.col("doc_id").alias("o_id")).distinct(), "media-others")
    # the texts stay where they are while those left out are few enough to send; beyond that bound they are shuffled
    others = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    first = rows.join(others, (F.col("digest") == F.col("o_digest")) & F.col("doc_id").eqNullSafe(F.col("o_id")), "left_anti")
    # a document that comes twice as the same row may have been stored twice: all refer to one of the members
    places = cut(store(first, root), "media-stored").groupBy("digest").agg(F.min(F.struct(*PLACES.names[1:])).alias("at")).select("digest", "at.*")
    return cut(rows.select("doc_id", "digest").join(places, "digest").drop("digest"), "media-index")


def spread(index: DataFrame, shard: str, offset: str, length: str) -> DataFrame:
    """The index dealt by place, so that tasks read neighbouring ranges and about READ_BYTES each."""
    spark = index.sparkSession
    total = index.agg(F.sum(length)).first()[0] or 0
    return index.repartitionByRange(max(spark.sparkContext.defaultParallelism, total // READ_BYTES + 1), shard, offset).sortWithinPartitions(shard, offset)


def with_metadata(index: DataFrame, root: str) -> DataFrame:
    """index with width, height and bit_depth, from range reads of the headers alone."""
    new = [pa.field("width", pa.int32()), pa.field("height", pa.int32()), pa.field("bit_depth", pa.int32())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ShardReader(root)
        for b in it:
            heads = [read_header(store.read(s, o, HEADER_BYTES)) for s, o in zip(b.column("shard").to_pylist(), b.column("media_offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([h[i] for h in heads], pa.int32()) for i in range(3)]], schema=pa.schema([*b.schema, *new]))
        store.close()

    return index.mapInArrow(run, f"{ddl(index)}, width int, height int, bit_depth int")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


FEATURES = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("stored_sha256", pa.string()), ("feature", pa.string())])


def with_features(rows: DataFrame, root: str) -> DataFrame:
    """rows (shard, media_offset, media_bytes) with digests and the feature of the payload, computed from the stored bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ShardReader(root)
        for b in it:
            out: dict[str, list] = {k: [] for k in FEATURES.names}
            for place in zip(*[b.column(c).to_pylist() for c in ("shard", "media_offset", "media_bytes")], strict=True):
                media = store.read(*place)
                payload = decode_png(media)
                got = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(media).hexdigest(), feature(payload))
                for k, v in zip(FEATURES.names, got, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *batches(out, FEATURES).columns], schema=pa.schema([*b.schema, *FEATURES]))
        store.close()

    return rows.mapInArrow(run, f"{ddl(rows)}, payload_bytes long, payload_sha256 string, tail_crc32 long, stored_sha256 string, feature string")


def media_columns(docs: DataFrame, root: str) -> DataFrame:
    """write_media's rows with the metadata and features of their payloads, each member being read once."""
    index = write_media(docs, root)
    places = index.drop("doc_id").distinct()
    read = with_features(with_metadata(spread(places, "shard", "media_offset", "media_bytes"), root), root)
    return index.select("doc_id", "media_sha256").join(read, "media_sha256")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all documents as pictures, read them back and return their columns."""
    rows = media_columns(table(spark, sf_dir, "documents"), work_dir(spark, "media"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("stored_sha256").alias("media_sha256"), "feature", "width", "height", "shard", "media_offset")
