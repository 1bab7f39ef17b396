"""WARC archives with revisit resolution.

A crawl is written as WARC 1.1 archives, one gzip member a record, every page a response. Resolution then works on the
record headers alone: they are shuffled by payload digest, of equal payloads of at least `MIN_BYTES` bytes the record
with the largest page_id stays a response and the others become revisits to it. Deduplicated archives are written with
fresh headers: responses carry the payload, revisits none but the response's HTTP header, digest and reference.

Defined results: a null html is an empty payload; payloads below MIN_BYTES are always responses; rows repeated with
the same page_id and payload are ordered by their place in the crawl archives, the first being the larger; an empty
table gives no archive and no row; other columns of the pages are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ShardReader, ShardWriter, batches, binary_list, cut, small_batches, table, work_dir
from .media import spread

MIN_BYTES = 1000
SHARD_BYTES = 256 << 20
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

HEADERS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("shard", pa.string()), ("place", pa.int64()), ("stored", pa.int64())])
HEADERS_DDL = "page_id long, url string, digest string, payload_bytes long, shard string, place long, stored long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "\r\n".join([VERSION, *[f"{k}: {' '.join(v.split())}" for k, v in fields], f"Content-Length: {len(block)}"])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def labelled(digest: str) -> str:
    """A SHA-1 as WARC writes it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def bare(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def identity(page_id: int | None, url: str, digest: str) -> list[tuple[str, str]]:
    return [("WARC-Record-ID", record_id(page_id)), ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Target-URI", url), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", labelled(digest))]


def write_crawl(pages: DataFrame, root: str) -> DataFrame:
    """Write every page as a response; returns the record headers and places. One pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ShardWriter(root, ".warc.gz", SHARD_BYTES)
        for b in it:
            rows: dict[str, list] = {f.name: [] for f in HEADERS}
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), binary_list(b.column(2)), strict=True):
                html, url = html or b"", url or ""
                digest = hashlib.sha1(html).hexdigest()
                member = record([("WARC-Type", "response"), *identity(page_id, url, digest)], http_head(len(html)) + html)
                out.room(len(member))
                for k, v in zip(HEADERS.names, (page_id, url, digest, len(html), out.name, out.put(member), len(member)), strict=True):
                    rows[k].append(v)
            yield batches(rows, HEADERS)
        out.close()

    small_batches(pages.sparkSession)
    return cut(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, HEADERS_DDL), "warc-headers")


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """headers with refers_to (the response's page_id, null for a response).

    The originals of repeated digests are a table of their own, summed before the shuffle; records meet them by digest
    in a sort-merge join, whose hot digests Spark splits.
    """
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.col("shard").alias("s"), F.col("place").alias("p"))
    groups = headers.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max(order).alias("kept"), F.count("*").alias("n")).where("n > 1")
    originals = cut(groups.select(F.col("digest").alias("o_digest"), F.when(F.col("kept.id") != -(1 << 63), F.col("kept.id")).alias("o_id"), F.col("kept.s").alias("o_shard"), F.col("kept.p").alias("o_place")), "warc-originals")
    j = headers.join(originals, (headers["digest"] == originals["o_digest"]) & (headers["payload_bytes"] >= min_bytes), "left")
    revisit = F.col("o_digest").isNotNull() & ~((F.col("shard") == F.col("o_shard")) & (F.col("place") == F.col("o_place")))
    return j.select(*headers.columns, revisit.alias("revisit"), F.when(revisit, F.col("o_id")).alias("refers_to"))


PLACES = pa.schema([("page_id", pa.int64()), ("shard", pa.string()), ("place", pa.int64()), ("stored", pa.int64())])
PLACES_DDL = "page_id long, shard string, place long, stored long"


def write_deduplicated(resolved: DataFrame, crawl: str, root: str) -> DataFrame:
    """Write archives in which revisits have no payload; returns the places of the new records."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, old = ShardWriter(root, ".warc.gz", SHARD_BYTES), ShardReader(crawl)
        for b in it:
            rows: dict[str, list] = {f.name: [] for f in PLACES}
            for r in b.to_pylist():
                fields = identity(r["page_id"], r["url"], r["digest"])
                if r["revisit"]:
                    fields = [("WARC-Type", "revisit"), *fields, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r["refers_to"])), ("WARC-Refers-To-Page-ID", "" if r["refers_to"] is None else str(r["refers_to"]))]
                    member = record(fields, http_head(r["payload_bytes"]))
                else:
                    payload = parse(old.read(r["shard"], r["place"], r["stored"]))[2]
                    member = record([("WARC-Type", "response"), *fields], http_head(len(payload)) + payload)
                out.room(len(member))
                for k, v in zip(PLACES.names, (r["page_id"], out.name, out.put(member), len(member)), strict=True):
                    rows[k].append(v)
            yield batches(rows, PLACES)
        out.close(), old.close()

    return cut(spread(resolved, "shard", "place", "stored").mapInArrow(run, PLACES_DDL), "warc-places")


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
RECORDS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(places: DataFrame, root: str) -> DataFrame:
    """Parse records at their places; a response's digest and length are those of the bytes read, a revisit's those of its headers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ShardReader(root)
        for b in it:
            rows: dict[str, list] = {f.name: [] for f in RECORDS}
            for shard, place, stored in zip(b.column("shard").to_pylist(), b.column("place").to_pylist(), b.column("stored").to_pylist(), strict=True):
                fields, http, payload = parse(store.read(shard, place, stored))
                response = fields["WARC-Type"] == "response"
                digest = hashlib.sha1(payload).hexdigest() if response else bare(fields["WARC-Payload-Digest"])
                refers = fields.get("WARC-Refers-To-Page-ID")
                values = (int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None, len(payload) if response else int(http["Content-Length"]), digest, fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"])
                for k, v in zip(RECORDS.names, values, strict=True):
                    rows[k].append(v)
            yield batches(rows, RECORDS)
        store.close()

    return spread(places, "shard", "place", "stored").mapInArrow(run, RECORDS_DDL)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, resolve revisits, and read the deduplicated archives back."""
    crawl, root = work_dir(spark, "warc-crawl"), work_dir(spark, "warc")
    resolved = cut(resolve(write_crawl(table(spark, sf_dir, "pages"), crawl)), "warc-resolved")
    return read_archives(write_deduplicated(resolved, crawl, root), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: sha1 of the payload is DuckDB's; ties of repeated rows don't occur in the tables.
OP4_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.payload_bytes < 1000 OR p.page_id = k.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.payload_bytes < 1000 OR p.page_id = k.top THEN NULL ELSE k.top END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest
"""
