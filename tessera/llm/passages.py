"""Repeated windows across documents: the distributed frame of the two substring operators.

A window is W units in a row (bytes or words) of one document; wanted are all windows whose content also starts earlier.
Each window is filed under its anchor, the least hash among its grams of k units: equal windows have equal anchors.
Neighbouring windows with one anchor form a segment, so a document has about 2 / (W - k + 2) segments for each unit.

1. Segments become rows (key = anchor hash, sig = hash of the segment, place). A task first takes together what repeats
   within its own rows; a key therefore meets each sig once a task and batch of segments.
2. Rows are grouped by key. A segment whose sig came earlier is a candidate: it is likely to repeat the place where that
   sig came first. A sig that comes first, under a key with several sigs, may share part of its windows with those.
3. Texts are fetched. Candidates meet the block of the document that they point to, a reference of a fixed number of
   windows, once for all candidates; runs of candidates stay whole. First segments meet by key.
4. A solver compares the texts that meet and returns the runs of windows that start earlier elsewhere: the suffix array in
   `suffixes`, the Lempel-Ziv factors in `factors`. Nothing is removed that a solver has not found equal in the text.
5. Runs are gathered by document and cut out.

Hashes decide only which texts meet. Keys under which a sample of documents shows many different segments are filed by
single windows; a key that still gathers more than WIDE segments is split into windows before its texts are shuffled; the
candidates of a reference block that exceed CROWD windows are dealt over several copies of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_list, cut, small_batches

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Units handled at once; positions must fit the low bits of an anchor.
PIECE = 1 << 21
LOW_BITS = np.uint64(24)
#: Segments that a task looks at together for repeats of its own.
LOCAL = 250_000
#: Sampled documents, and the different segments among them that make a key frequent.
SAMPLE_DOCS, FREQUENT = 5000, 20
WIDE = 20_000
#: Windows of candidates that meet one copy of a reference block.
CROWD = 1 << 18
#: Bytes of text that leave a task as one batch, and that a solver gets at once (about what a core's cache holds); a key's
#: segments stay together.
BATCH, BLOCK_BYTES = 2 << 20, 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        v, done = np.minimum(v[:-done], v[done:]), 2 * done
    return np.minimum(v[: len(v) - (width - done)], v[width - done :]) if done < width else v


class Sums:
    """Hashes of ranges of a sequence of 64-bit values, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE, inverse: np.uint64 = INVERSE):
        n = len(values)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]))
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(values * power[:n])])
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[stop] - self.prefix[start]) * self.down[start] + (stop - start).astype(np.uint64))


@dataclass(frozen=True)
class Bytes:
    """Units are the bytes of the text."""

    window: int = 100
    gram: int = 24
    #: Windows of a reference block, as a power of two.
    block: int = 12

    def units(self, texts: list[bytes]) -> list:
        return texts

    def grams(self, pieces: list) -> np.ndarray:
        """Gram hashes at every unit of the pieces, laid out with one unit between them."""
        data = b"\0".join(pieces) + bytes(self.gram + 8)
        words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
        n = len(data) - self.gram - 7
        h = np.zeros(n, np.uint64)
        for i in range(0, self.gram, 8):
            h = mixed(h * BASE + words[i : i + n])
        return h

    def text(self, units, start: int, stop: int) -> bytes:
        return units[start:stop]

    def keep(self, units, mask: np.ndarray) -> bytes:
        return np.frombuffer(units, np.uint8)[mask].tobytes()


@dataclass(frozen=True)
class Words:
    """Units are the words between ASCII blanks."""

    window: int = 20
    gram: int = 6
    block: int = 10

    def units(self, texts: list[bytes]) -> list:
        return [t.split() for t in texts]

    def grams(self, pieces: list) -> np.ndarray:
        from xxhash import xxh64_intdigest

        sizes = [len(p) for p in pieces]
        known = {w: xxh64_intdigest(w) for w in {w for p in pieces for w in p}}
        n = sum(sizes) + len(sizes)
        data, at = np.zeros(n + self.gram, np.uint64), 0
        for p, size in zip(pieces, sizes, strict=True):
            data[at : at + size] = np.fromiter(map(known.__getitem__, p), np.uint64, size)
            at += size + 1
        h = np.zeros(n, np.uint64)
        for i in range(self.gram):
            h = mixed(h * BASE + data[i : i + n])
        return h

    def text(self, units, start: int, stop: int) -> bytes:
        return b" ".join(units[start:stop])

    def keep(self, units, mask: np.ndarray) -> bytes:
        from itertools import compress

        return b" ".join(compress(units, mask.tolist()))


def segments(unit, pieces: list, bases: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """piece, place (in the document), count of windows, key and sig of the segments of the pieces."""
    w, k = unit.window, unit.gram
    g = w - k + 1
    h = unit.grams(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    windows = np.maximum(sizes - w + 1, 0)
    least = sliding_min((h >> LOW_BITS << LOW_BITS) | np.arange(len(h), dtype=np.uint64), g)
    piece = np.repeat(np.arange(len(pieces)), windows)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[piece] + place
    anchor = (least[at] & np.uint64((1 << int(LOW_BITS)) - 1)).astype(np.int64)
    head = np.ones(len(at), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(at)))
    key = h[anchor[first]]
    sums = Sums(h)
    sig = sums.of(at[first], at[first] + count + g - 1)
    rows = [piece[first], place[first], count, key, sig]
    if len(frequent) and len(key):
        hot = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
        if hot.any():
            single = np.repeat(hot, count)
            s = at[single]
            other = Sums(h, np.uint64(0xBF58476D1CE4E5B9), np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64)))
            ones = [piece[single], place[single], np.ones(len(s), np.int64), other.of(s, s + g), sums.of(s, s + g)]
            rows = [np.concatenate([a[~hot], b]) for a, b in zip(rows, ones, strict=True)]
    rows[1] = rows[1] + bases[rows[0]]
    return tuple(rows)


ROWS = pa.schema([(n, pa.int64()) for n in ("key", "sig", "d", "t", "p", "c", "rd", "rt", "rp")])
ROWS_DDL = "key long, sig long, d long, t long, p long, c long, rd long, rt long, rp long"


class Local:
    """Segments of one task: repeats among them leave as runs of candidates with the place (rd, rt, rp) they point to, the
    rest as rows to be grouped, where that is null. A run points into one reference block."""

    def __init__(self, block: int):
        self.block = block
        self.docs: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, docs: list[tuple[int, int]], found: tuple[np.ndarray, ...]) -> None:
        self.parts.append((found[0] + len(self.docs), *found[1:]))
        self.docs += docs
        self.held += len(found[0])

    def flush(self) -> pa.RecordBatch:
        doc, place, count, key, sig = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        d, t = (np.array(x, np.int64) for x in zip(*self.docs, strict=True))
        rank = np.empty(len(d), np.int64)
        order = np.lexsort((t, d))
        same = np.append(False, (d[order][1:] == d[order][:-1]) & (t[order][1:] == t[order][:-1]))
        rank[order] = np.cumsum(~same)
        by_place = np.lexsort((place, rank[doc]))
        doc, place, count, key, sig = (x[by_place] for x in (doc, place, count, key, sig))
        both = np.argsort(mixed(key) ^ sig, kind="stable")
        again = np.append(False, (key[both][1:] == key[both][:-1]) & (sig[both][1:] == sig[both][:-1]))
        lead = np.flatnonzero(~again)[np.cumsum(~again) - 1]
        first = np.empty(len(key), np.int64)  # the row each one repeats
        first[both] = both[lead]
        # a document that comes twice as the same row is one document: its segments don't repeat each other
        twin = (rank[doc] == rank[doc[first]]) & (place == place[first])
        r = np.flatnonzero((first != np.arange(len(key))) & ~twin)
        to, at = doc[first[r]], place[first[r]]
        run = np.ones(len(r), bool)
        ends = lambda x: x[1:] != x[:-1] + count[r][:-1]
        run[1:] = (doc[r][1:] != doc[r][:-1]) | ends(place[r]) | (rank[to][1:] != rank[to][:-1]) | ends(at) | (at[1:] >> self.block != at[:-1] >> self.block)
        heads = np.flatnonzero(run)
        n = np.add.reduceat(count[r], heads) if len(r) else np.empty(0, np.int64)
        who, where = doc[r][heads], place[r][heads]
        f = np.setdiff1d(np.arange(len(key)), r, assume_unique=True)
        own = mixed(d[who].astype(np.uint64) * BASE + where.astype(np.uint64))
        both = lambda x, y: np.concatenate([x, y])
        columns = [both(key[f], own).view(np.int64), both(sig[f], own).view(np.int64), d[both(doc[f], who)], t[both(doc[f], who)], both(place[f], where), both(count[f], n)]
        none = np.arange(len(f) + len(heads)) < len(f)
        for x in (d[to[heads]], t[to[heads]], at[heads]):
            columns.append(both(np.zeros(len(f), np.int64), x))
        self.__init__(self.block)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), mask=none if i > 5 else None) for i, c in enumerate(columns)], schema=ROWS)


def segment_rows(docs: DataFrame, unit, frequent: np.ndarray) -> DataFrame:
    """The rows ROWS of docs (d, t, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, hot = Local(unit.block), shared.value
        for b in it:
            ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            pieces, owner, bases, size = [], [], [], 0
            for i, units in enumerate(unit.units([x or b"" for x in binary_list(b.column(2))])):
                for start in range(0, max(1, len(units) - unit.window + 1), PIECE):
                    part = units[start : start + PIECE + unit.window - 1] if len(units) > PIECE else units
                    pieces.append(part), owner.append(ids[i]), bases.append(start)
                    size += len(part)
                    if size >= PIECE:
                        local.add(owner, segments(unit, pieces, np.array(bases), hot))
                        pieces, owner, bases, size = [], [], [], 0
            if pieces:
                local.add(owner, segments(unit, pieces, np.array(bases), hot))
            if local.held >= LOCAL:
                yield local.flush()
        if local.held:
            yield local.flush()

    return docs.mapInArrow(run, ROWS_DDL)


def frequent_keys(docs: DataFrame, unit, count: int) -> np.ndarray:
    """Keys with many different segments in a sample of about SAMPLE_DOCS docs; they steer where rows meet, not what is found."""
    sample = docs if count <= SAMPLE_DOCS else docs.sample(SAMPLE_DOCS / count, 5)
    rows = segment_rows(sample, unit, np.empty(0, np.uint64)).where("rp is null").select("key", "sig").distinct()
    keys = rows.groupBy("key").count().where(F.col("count") >= FREQUENT).select("key").collect()
    return np.sort(np.array([r["key"] for r in keys], np.int64).view(np.uint64))


def prepared(docs: DataFrame) -> DataFrame:
    """d, t (the order of documents), row (all columns). t tells apart different texts under one doc_id, 0 where ids are unique."""
    some = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).collect()
    tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) if some else F.lit(0).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), tie.alias("t"), F.struct("*").alias("row"))


RUNS_DDL = "d long, t long, p long, c long"
RUNS = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("p", pa.int64()), ("c", pa.int64())])
PARTS_DDL = "key long, d long, t long, p long, c long, part binary"
PARTS = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("p", pa.int64()), ("c", pa.int64()), ("part", pa.binary())])


def row_text(b: pa.RecordBatch) -> list[bytes]:
    rows = b.column("row")
    text = rows.field(rows.type.get_field_index("text"))
    if rows.null_count:
        text = pa.compute.if_else(rows.is_valid(), text, None)
    return [x or b"" for x in binary_list(text)]


def nested(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Offsets and the members, as numbers, of a column list<struct>."""
    flat = column.flatten()
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), *[flat.field(flat.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


#: What is asked of a document's text: a segment, its windows one by one, a candidate, a reference block (p is its number).
SEGMENT, WINDOWS, CANDIDATE, REFERENCE = range(4)


def pieces_of(units, asked: np.ndarray, unit) -> Iterator[tuple[int | None, int, int, bytes]]:
    """key (None: the text's own), place, windows and text of the parts that a document's requests (rows key, p, c, kind) stand for."""
    w, top = unit.window, len(units) - unit.window + 1
    last: list[int] | None = None  # candidates that lie next to each other stay together
    for key, p, c, kind in [*asked[np.lexsort((asked[:, 1], asked[:, 0], asked[:, 3] != CANDIDATE))].tolist(), (None, -1, 0, -1)]:
        if last and not (kind == CANDIDATE and key == last[0] and p == last[1] + last[2]):
            yield last[0], last[1], last[2], unit.text(units, last[1], last[1] + last[2] - 1 + w)
            last = None
        if kind == CANDIDATE:
            if last:
                last[2] += c
            else:
                last = [key, p, c]
        elif kind == REFERENCE:
            start, stop = p << unit.block, min(top, ((p + 1) << unit.block) + w - unit.gram)
            yield key, start, stop - start, unit.text(units, start, stop - 1 + w)
        elif kind == SEGMENT:
            yield key, p, c, unit.text(units, p, p + c - 1 + w)
        elif kind == WINDOWS:
            for i in range(c):
                yield None, p + i, 1, unit.text(units, p + i, p + i + w)


def fetch(docs: DataFrame, asked: DataFrame, unit) -> DataFrame:
    """PARTS: the texts of the requests asked (d, t, key, p, c, kind); windows come under keys of their own."""
    lists = asked.groupBy("d", "t").agg(F.collect_list(F.struct("key", "p", "c", "kind")).alias("parts"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in PARTS}
        size = 0
        for b in it:
            ids, texts = list(zip(b.column("d").to_pylist(), b.column("t").to_pylist(), strict=True)), row_text(b)
            at, *columns = nested(b.column("parts"), ("key", "p", "c", "kind"))
            asked = np.stack(columns, 1).astype(np.int64).reshape(-1, 4)
            for i, units in enumerate(unit.units(texts)):
                for key, p, c, part in pieces_of(units, asked[at[i] : at[i + 1]], unit):
                    own = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True) if key is None else key
                    for name, v in zip(PARTS.names, (own, *ids[i], p, c, part), strict=True):
                        out[name].append(v)
                    size += len(part)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in PARTS], schema=PARTS)
                        out, size = {f.name: [] for f in PARTS}, 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in PARTS], schema=PARTS)

    return docs.join(lists, ["d", "t"]).mapInArrow(run, PARTS_DDL)


def requests(found: DataFrame, unit) -> DataFrame:
    """d, t, key, p, c, kind: what `fetch` is asked for by the rows of found (key, d, t, p, c, rd, rt, rp, wide)."""
    kind = F.when(F.col("wide"), WINDOWS).otherwise(SEGMENT).cast("long")
    firsts = found.where("rp is null").select("d", "t", "key", "p", "c", kind.alias("kind"))
    near = found.where("rp is not null").withColumn("block", F.shiftright("rp", unit.block))
    # references by the windows that point to them, and as many copies of each as those fill
    into = near.groupBy("rd", "rt", "block").agg(F.sum("c").alias("n"))
    into = cut(into.withColumn("copies", F.ceil(F.col("n") / CROWD)), "passages-references")
    key = F.xxhash64("rd", "rt", "block", "copy")
    references = into.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    references = references.select(F.col("rd").alias("d"), F.col("rt").alias("t"), key.alias("key"), F.col("block").alias("p"), F.lit(0).cast("long").alias("c"), F.lit(REFERENCE).cast("long").alias("kind"))
    near = near.join(into.where("copies > 1").select("rd", "rt", "block", "copies"), ["rd", "rt", "block"], "left")
    near = near.withColumn("copy", F.coalesce(F.pmod(F.xxhash64("d", "t"), F.col("copies")), F.lit(0)).cast("long"))
    # what lies within the reference block itself is found there
    start = F.when((F.col("d") == F.col("rd")) & (F.col("t") == F.col("rt")), F.greatest("p", F.shiftleft(F.col("block") + 1, unit.block) + (unit.window - unit.gram))).otherwise(F.col("p"))
    near = near.withColumn("start", start).withColumn("left", F.col("c") - (F.col("start") - F.col("p"))).where("left > 0")
    return firsts.union(references).union(near.select("d", "t", key.alias("key"), F.col("start").alias("p"), F.col("left").alias("c"), F.lit(CANDIDATE).cast("long").alias("kind")))


Solver = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def solve(parts: DataFrame, unit, solver: Solver) -> DataFrame:
    """RUNS of the windows of parts that start earlier. solver(keys, counts, texts), segments in document order within
    a key, returns (segment, first window, number of windows) of each run."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, d, t, p, c = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in range(5))
        texts = [x for b in rows for x in b.column(5).to_pylist()]
        first = np.append(True, (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1]))  # a document that comes twice is one
        keep = np.flatnonzero(first)
        i, s, n = solver(key[keep], c[keep], [texts[x] for x in keep])
        i = keep[i]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d[i], t[i], p[i] + s, n)], schema=RUNS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(5).nbytes
            if size >= BLOCK_BYTES:
                key = b.column(0).to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # rows come sorted by key
                if last > 0:
                    yield block([*held[:-1], b.slice(0, last)])
                    held = [b.slice(last)]
                    size = held[0].column(5).nbytes * (b.num_rows - last) // b.num_rows
        if held:
            yield block(held)

    return parts.repartition("key").sortWithinPartitions("key", "d", "t", "p").mapInArrow(run, RUNS_DDL)


def repeated_runs(docs: DataFrame, unit, solver: Solver) -> DataFrame:
    """d, t, runs: for each document with repeated windows the list of (p, c), c windows from unit p on. docs: d, t, row."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select("d", "t", F.col("row.text").cast("string").alias("text"))
    rows = segment_rows(plain, unit, frequent_keys(plain, unit, docs.count()))
    order = Window.partitionBy("key").orderBy("sig", "d", "t", "p")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = rows.withColumn("new", F.coalesce(F.lag("sig").over(order) != F.col("sig"), F.lit(True)))
    known = known.withColumn("sigs", F.sum(F.col("new").cast("int")).over(whole))
    known = known.withColumn("first", F.last(F.when(F.col("new"), F.struct("d", "t", "p")), True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a document that comes twice is one document: its segments don't repeat each other
    twin = (F.col("first.d") == F.col("d")) & (F.col("first.t") == F.col("t")) & (F.col("first.p") == F.col("p"))
    near = F.col("rp").isNotNull() | (~F.col("new") & ~twin)
    place = [F.when(near, F.coalesce(F.col(f"r{c}"), F.col(f"first.{c}"))).alias(f"r{c}") for c in ("d", "t", "p")]
    found = known.where(near | (F.col("new") & (F.col("sigs") > 1))).select("key", "d", "t", "p", "c", *place, (F.col("sigs") > WIDE).alias("wide"))
    runs = solve(fetch(docs, requests(cut(found, "passages"), unit), unit), unit, solver)
    return runs.groupBy("d", "t").agg(F.collect_list(F.struct("p", "c")).alias("runs"))


CUT = pa.schema([("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, unit, solver: Solver) -> DataFrame:
    """row, n_units, n_removed, n_spans, kept for each row of docs: what is left of its text in bytes."""
    ready = prepared(docs)
    runs = repeated_runs(ready, unit, solver)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            at, p, c = nested(b.column("runs"), ("p", "c"))
            out: dict[str, list] = {f.name: [] for f in CUT}
            for i, units in enumerate(unit.units(row_text(b))):
                n = len(units)
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, p[at[i] : at[i + 1]], 1)
                np.add.at(edge, p[at[i] : at[i + 1]] + c[at[i] : at[i + 1]] - 1 + unit.window, -1)
                gone = np.cumsum(edge[:n]) > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for name, v in zip(CUT.names, (n, int(gone.sum()), spans, unit.keep(units, ~gone)), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(out[f.name], f.type) for f in CUT]], names=["row", *CUT.names])

    joined = ready.join(runs, ["d", "t"], "left")
    kind = T.StructType([T.StructField("row", ready.schema["row"].dataType), *[T.StructField(n, T.LongType()) for n in CUT.names[:3]], T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(run, kind)
