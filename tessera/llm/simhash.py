"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are the bitwise majorities of the XXH64 of all word shingles. The 64 bits are dealt to the 7 nonzero
vectors of F_2^3; table v keeps the bits whose vector is not orthogonal to v. For any 2 bits (or fewer) there is a v
orthogonal to both, so a pair within radius 2 agrees on all that table keeps: no pair is missed, by construction.

Within a bucket of a table no pairs are formed. Two fingerprints differ in at most 2 bits exactly if some 64-bit point
is within 1 bit of both, so every fingerprint of a bucket with company goes to its own point and those one of the
dropped bits away; whatever meets at a point is linked to the smallest fingerprint there. A group of thousands costs
a row for each member and dropped bit, never its square. Components follow by alternating large and small stars.

Defined results: null and empty texts have fingerprint 0 and are linked like others; fewer words than a shingle give
the whole sequence as one; repeated doc_ids keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_list, cut, discard, small_batches, table

RADIUS = 2
SHINGLE = 3
SEED = 42


def shingle_hashes(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of a whole text (A-Z lower-cased), repeats included; fewer words: the whole sequence; none: nothing."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, stops = np.concatenate([[0], ends[:-1] + 1])[:n], ends[min(shingle, len(words)) - 1 :]
    out = np.empty(n, np.uint64)
    for i in range(0, n, 65536):  # bounds the slices of very long texts
        out[i : i + 65536] = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i : i + 65536].tolist(), stops[i : i + 65536].tolist())]
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprint_bits(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text, unsigned."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint_bits(t or b"", shingle, seed) for t in binary_list(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], schema=schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS, width: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks, such that for any `radius` bits one mask keeps none of them."""
    vectors = (1 << (radius + 1)) - 1
    own = [i % vectors + 1 for i in range(width)]
    return [sum(1 << i for i in range(width) if (own[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that join all distinct values fp within 2 bits of each other, directly or through a common neighbour."""
    masks = covering_masks()
    buckets = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("kept")) for i, m in enumerate(masks)])).alias("at")
    rows = fps.select("fp", buckets).select("fp", "at.t", "at.kept")
    shared = cut(rows.groupBy("t", "kept").agg(F.count("*").alias("n"), F.min("fp").alias("one"), F.max("fp").alias("other")).where("n > 1").select("t", "kept"), "simhash-buckets")
    members = rows.join(shared, ["t", "kept"])
    dropped = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    points = members.select("fp", F.explode(F.element_at(dropped, F.col("t") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # a first sum by point, within tasks too, finds those where several meet; each member is then linked to the smallest
    met = cut(points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("point", "low"), "simhash-points")
    return points.join(met, "point").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest value of its component) for the edges (a, b), by alternating large and small stars; roots
    have no row of their own."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-low")
        large = cut(both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "cc-large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "cc-low")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = cut(small, "cc-edges")
        discard(edges, low, large, least)
        edges = after
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.lit(1).alias("up")), F.struct(F.col("b").alias("u"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        # stars only: every node has one edge upwards, and nodes that others point to have none
        if ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or ups = 1 and low = 0").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the smallest doc_id reachable over links of at most 2 bits."""
    rows = cut(fingerprints(docs, shingle), "simhash-fps")
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-groups")
    comp = cut(components(links(groups.select("fp"))), "simhash-components")
    roots = groups.join(comp, groups["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    roots = cut(roots, "simhash-roots")
    lowest = cut(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-lowest")
    classes = cut(roots.join(lowest, "root").select(F.col("fp").alias("c_fp"), "component_id"), "simhash-classes")
    return rows.join(classes, rows["fp"] == classes["c_fp"]).select("doc_id", "fp", "component_id")


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


# Near copies by shingle similarity: candidates by covering tables and by bands of least hashes, then exact verification.

#: Tables of least hashes: two texts meet in one if the least hashes of their shingles agree under BAND permutations, which
#: happens with the similarity to the power BAND. At 0.8 all TABLES fail with (1 - 0.8 ** 6) ** 32 = 6e-5, whatever the
#: edit: the shingle sets themselves are hashed. Long bands keep unlike texts with a common passage apart.
BAND, TABLES = 6, 32
#: Leaders of a bucket in the first round, with which its members are compared; LEADERS times more in each further one.
LEADERS = 4
#: Members beyond which a bucket that has outlasted the first round is split by shingles.
WIDE = 64
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Ratio of the largest to the smallest size in a class of sizes, when wide buckets are split.
SIZE_STEP = 1.06
#: Bits of a set's parities, a multiple of 64 and a power of two.
PARITIES = 2048
#: Longs to which the parities are folded for the first test of pairs, before they become rows.
FOLDED = 4
#: Bits of a filter for each key, and its words of 64 bits at most, a power of two; beyond them it lets more rows pass.
FILTER_BITS, FILTER_WORDS = 16, 1 << 20
#: One of so many sets is counted for the order of shingles, over SLOTS counters, a power of two. Any order is exact.
COUNTED, SLOTS = 8, 1 << 20


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The different hashes, sorted; texts without a word have one set in common."""
    return np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """For each of the TABLES a key of the set's BAND least hashes."""
    from .passages import mixed

    seeds = mixed(np.arange(1, BAND * TABLES + 1, dtype=np.uint64) << np.uint64(8))[:, None]
    factors, h = mixed(~seeds) | np.uint64(1), mixed(hashes)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for j in range(0, len(h), 512):  # keeps the products in the cache
        least = np.minimum(least, ((h[None, j : j + 512] ^ seeds) * factors).min(1))
    key = np.arange(TABLES, dtype=np.uint64)
    for row in least.reshape(BAND, TABLES):
        key = mixed(key ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return key


def keyed(docs: DataFrame) -> DataFrame:
    """docs as doc_id, text, digest (SHA-256 of the text, null as empty), row_hash (of all columns), row."""
    def plain(field: T.StructField) -> Column:
        c = F.col("`" + field.name.replace("`", "``") + "`")
        return F.to_json(F.struct(c)) if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType) else c

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row_hash = F.xxhash64(*[plain(f) for f in docs.schema.fields])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), row_hash.alias("row_hash"), F.struct("*").alias("row"))


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest, row_hash of keyed rows with fp, the fingerprint, and bands, the keys of the tables."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("row_hash", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hashes = [shingle_hashes(t, shingle) for t in binary_list(b.column(3))]
            fps = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            keys = [band_keys(shingle_set(h)).view(np.int64) for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary()), b.column(2), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "digest", "row_hash", "text").mapInArrow(run, "doc_id long, digest binary, row_hash long, fp long, bands array<long>")


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits as longs, each the parity of the set's hashes that fall on it. Two sets differ in at least as many hashes as bits."""
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, hashes (the shingle_set) and its parities of texts (node, text)."""
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.binary()), ("parity", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingle_set(shingle_hashes(t, shingle)) for t in binary_list(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([parities(x) for x in sets], schema.field(2).type)], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary, parity array<long>")


def possible(m: Column, n: Column, p: Column, q: Column, similarity: float) -> Column:
    """False only for sets of m and n bytes with parities p and q, whole or folded, that can't have the similarity."""
    differing = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)
    return (F.least(m, n) >= similarity * F.greatest(m, n)) & (differing <= (m + n) / 8 * ((1 - similarity) / (1 + similarity)) + 1e-6)


def folded(parity: str) -> Column:
    """Parities of the same hashes on fewer bits."""
    parts = [F.col(parity)[i] for i in range(PARITIES // 64)]
    out = []
    for i in range(FOLDED):
        bits = parts[i]
        for x in parts[i + FOLDED :: FOLDED]:
            bits = bits.bitwiseXOR(x)
        out.append(bits)
    return F.array(*out)


def marked(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """rows with `maybe`: false only where no row of keys, a small stored table, has their values of the columns on.

    A bitmap of the keys' hashes goes to all tasks (16 bits a key: 6 % of other rows pass), so that an exact join need
    not shuffle the rows that have no match.
    """
    words = 1
    while words < min(FILTER_WORDS, keys.count() * FILTER_BITS / 64):
        words *= 2
    h = F.xxhash64(*on)
    word, bit = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1).cast("long")), h.bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = keys.select(word.alias("f_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("f_word").agg(F.bit_or("bit").alias("f_bits"))
    return rows.join(F.broadcast(bits), word == F.col("f_word"), "left").withColumn("maybe", F.coalesce(F.getbit("f_bits", bit) == 1, F.lit(False))).drop("f_word", "f_bits")


def among(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows that marked lets pass: all that have a match in keys, and few others."""
    return marked(rows, keys, *on).where("maybe").drop("maybe")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets (node, hashes, size, parity) have a Jaccard similarity of `similarity` or more.

    Pairs that the sizes exclude, or the parities (sets of m and n hashes may differ in (m + n) (1 - similarity) / (1 + similarity)
    of them at most), go before any set is sent; both tests lose no pair.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=schema)

    brief = sets.select("node", "size", "parity")
    near = pairs.join(brief.toDF("a", "m", "p"), "a").join(brief.toDF("b", "n", "q"), "b").where(possible(F.col("m"), F.col("n"), F.col("p"), F.col("q"), similarity))
    near = cut(near.select("a", "b"), "near-pairs")
    if near.isEmpty():
        return near
    ends = cut(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "near-ends")
    sets = among(sets.select("node", "hashes"), ends, "node")
    x, y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    found = cut(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-found")
    discard(near, ends)
    return found


def slot_counts(sets: DataFrame) -> np.ndarray:
    """For each of SLOTS the number of sets (node, hashes), of one in COUNTED, times their shingles that fall on it."""
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                slots, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) & np.uint64(SLOTS - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slots.view(np.int64)), pa.array(n, pa.int64())], schema=schema)

    some = sets.where(F.pmod(F.xxhash64("node", F.lit(29)), F.lit(COUNTED)) == 0).select("hashes")
    found = some.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").cast("int").alias("n")).where("n > 1").toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def first_shingles(sets: DataFrame) -> DataFrame:
    """node, n, shingle and place (from 1) of the first `most` shingles of each set (node, n, most, hashes), rarest first.

    The order is by the count of a shingle's slot, then by the shingle: the same in all sets, whatever was counted.
    """
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64()), ("place", pa.int64())])
    counts = sets.sparkSession.sparkContext.broadcast(slot_counts(sets))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for node, n, most, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(held, np.uint64)
                x = x[np.lexsort((x, counts.value[x & np.uint64(SLOTS - 1)]))[:most]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), node)), pa.array(np.full(len(x), n)), pa.array(x.view(np.int64)), pa.array(np.arange(1, len(x) + 1))], schema=schema)

    return sets.select("node", "n", "most", "hashes").mapInArrow(run, "node long, n long, shingle long, place long")


def split_wide(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Buckets (key, node, own) in which all pairs of `similarity` or more among the nodes of rows meet again, one of the two as own.

    Sets of m <= n hashes share at least s / (1 + s) (m + n) of them, so with shingles in one order for all sets, they share
    one of the first m - that + 1 and n - that + 1. Any order will do; about rarest first, few others meet. Only these first
    ones, a fifth of a set, become rows. A set is filed as own in its class of sizes, as the smaller of a pair, and in every
    class down to `similarity` of its size as the larger: unlike texts with a common passage meet only where what is their
    own is short enough for such a pair.
    """
    nodes = cut(rows.select("node").distinct(), "near-wide")
    share, n = similarity / (1 + similarity), F.col("n")
    least = F.ceil(n * F.lit(similarity) - 1e-9)

    def reach(m: Column) -> Column:
        return n - F.ceil((n + m) * F.lit(share) - 1e-9) + 1

    def size_class(m: Column) -> Column:
        return F.floor(F.log(m) / F.log(F.lit(SIZE_STEP)) + 1e-9)

    held = among(sets.select("node", (F.col("size") / 8).cast("long").alias("n"), "hashes"), nodes, "node").join(nodes, "node")
    first = cut(first_shingles(held.withColumn("most", reach(least))), "near-first")
    # a shingle that comes first in one set only meets nothing
    often = cut(first.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1").select("shingle"), "near-often")
    placed = among(first, often, "shingle").join(often, "shingle")
    filed = placed.withColumn("class", F.explode(F.sequence(size_class(least), size_class(n))))
    low = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("class") - 1e-6)))
    filed = filed.where(F.col("place") <= reach(low)).select(F.xxhash64("shingle", "class").alias("key"), "node", ((F.col("class") == size_class(n)) & (F.col("place") <= reach(n))).alias("own"))
    out = cut(filed, "near-split")
    discard(nodes, first, often)
    return out


def similar_groups(rows: DataFrame, edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """node, root of the components under `similarity`, over all pairs of nodes that rows (key, node, own) put into one bucket, one
    of the two as own, and the candidates edges (a, b); nodes alone have no row.

    A bucket lives while its members have different roots. In rounds its leaders, some of those that aren't of the root
    of a member picked at random, are compared with all its members of other roots, and leave it. So of any two members
    either one was a leader beside the other, or they came to have one root: no link is lost, and a bucket of thousands
    of near copies takes a few rows a member, never its square. A bucket that stays wide is split by shingles once.
    Members that aren't own need no comparison among themselves.
    The table of rows is deleted as soon as the rounds have one of their own.
    """
    def grouped(found: DataFrame, known: DataFrame | None) -> DataFrame:
        old = found.select("a", "b") if known is None else found.select("a", "b").union(known.select("node", "root"))
        return cut(components(old), "near-roots")

    first = verified(edges, sets, similarity)
    roots = grouped(first, None)
    discard(first)
    leaders, split = LEADERS, False
    while True:
        rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        one = F.min_by("root", F.struct(F.xxhash64("node", F.lit(leaders)), "node"))
        state = rooted.groupBy("key").agg(one.alias("main"), F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.max("own").alias("any")).where("low <> high and any")
        live = cut(rooted.join(state.select("key", "main", "n"), "key"), "near-live")
        discard(rows)
        if live.isEmpty():
            discard(live)
            return roots
        if leaders > LEADERS and not split:
            split = True
            wide = live.where(F.col("n") > WIDE)
            if not wide.isEmpty():
                finer = split_wide(wide, sets, similarity)
                rows = cut(live.where(F.col("n") <= WIDE).select("key", "node", "own").union(finer), "near-rows")
                discard(live, finer)
                continue
        # in the first round nearly all pairs are links; later ones test them before they become rows
        seen = [] if leaders == LEADERS else ["size", "folded"]
        if seen:
            live, old = cut(live.join(sets.select("node", "size", folded("parity").alias("folded")), "node"), "near-live"), live
            discard(old)
        part = F.pmod(F.xxhash64("node", F.lit(13)), F.lit(leaders))
        led = live.where("root <> main").groupBy("key", part.alias("part")).agg(F.min(F.struct((~F.col("own")).alias("late"), "node", "root", "own", *seen)).alias("lead")).groupBy("key").agg(F.collect_list("lead").alias("leads"))
        met = cut(live.join(led, "key").select("key", "node", "root", "own", "leads", *seen), "near-met")

        def apart(x: Column) -> Column:
            test = (x["root"] != F.col("root")) & (x["own"] | F.col("own"))
            return test & possible(x["size"], F.col("size"), x["folded"], F.col("folded"), similarity) if seen else test

        pairs = met.select("node", F.explode(F.filter("leads", apart)).alias("lead")).select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b")).distinct()
        found = verified(pairs, sets, similarity)
        rows = cut(met.where(~F.exists("leads", lambda x: x["node"] == F.col("node"))).select("key", "node", "own"), "near-rows")
        if not found.isEmpty():
            roots, old = grouped(found, roots), roots
            discard(old)
        discard(live, met, found)
        leaders *= LEADERS


def near_copy_groups(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Groups of rows with equal or similar texts: keep (digest, row_hash) of the row that stands for each group, and the base
    table of sketches.

    Every different text is a node. Candidates are the covering tables' links between five-word fingerprints (radius
    RADIUS, as op6) and the buckets of bands; links are the candidates of `similarity` or more; groups their components.
    """
    rows = keyed(docs)
    base = cut(sketches(rows, shingle), "near-base")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")
    reps = cut(base.groupBy("digest").agg(F.min(own).alias("own"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "near-reps")
    fps = cut(reps.groupBy("fp").agg(F.min("node").alias("low")), "near-fps")
    same = reps.join(fps, "fp").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    covered = links(fps.select("fp")).join(fps.toDF("a", "a_node"), "a").join(fps.toDF("b", "b_node"), "b").select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))
    edges = cut(same.union(covered).distinct(), "near-covered")
    banded = reps.select("node", F.explode("bands").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-shared")
    buckets = cut(among(banded, shared, "key").join(shared, "key").withColumn("own", F.lit(True)), "near-rows")
    discard(shared)
    wanted = buckets.select("node").union(edges.select("a")).union(edges.select("b")).distinct()
    wanted = cut(reps.join(wanted, "node").select("node", "digest", F.col("own.row_hash").alias("row_hash")), "near-wanted")
    texts = among(rows.select("digest", "row_hash", "text"), wanted, "row_hash").join(wanted, ["digest", "row_hash"]).dropDuplicates(["digest", "row_hash"])
    sets = cut(shingle_sets(texts, shingle).withColumn("size", F.octet_length("hashes")), "near-sets")
    roots = similar_groups(buckets, edges, sets, similarity)
    members = reps.select("node", "digest", "own").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = members.groupBy("root").agg(F.min(F.struct("own", "digest")).alias("first")).select("first.digest", F.col("first.own.row_hash").alias("row_hash"))
    keep = cut(keep, "near-keep")
    discard(reps, fps, edges, wanted, sets, roots)
    return keep, base


def without_near_copies(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """docs with one row of each group of exact and near copies, the one with the smallest doc_id; all columns kept.

    Defined results: a null text is an empty one, and texts without a word are copies of each other; null ids come last;
    rows that are equal in all columns leave one; different texts under one doc_id are texts of their own; of rows with
    one text and doc_id the one with the smallest hash stays; an empty table gives an empty result.
    """
    keep, base = near_copy_groups(docs, shingle, similarity)
    counts = base.groupBy("digest", "row_hash").agg(F.count("*").alias("n"))
    # what goes is less than what stays; equal rows that stay leave one by a second way, where there are such
    gone = cut(counts.join(keep, ["digest", "row_hash"], "left_anti").select("digest", "row_hash"), "near-gone")
    several = cut(counts.where("n > 1").join(keep, ["digest", "row_hash"]).select("digest", "row_hash"), "near-several")
    discard(base, keep)
    # most rows are seen to stay by a filter; only the others are shuffled, whole, to be held against the lists
    doubtful = cut(gone.union(several), "near-doubtful")
    rows = marked(keyed(docs).select("digest", "row_hash", "row"), doubtful, "row_hash")
    plain, left = rows.where("not maybe"), rows.where("maybe").join(gone, ["digest", "row_hash"], "left_anti")
    if not several.isEmpty():
        once = left.join(several, ["digest", "row_hash"]).dropDuplicates(["digest", "row_hash"])
        left = left.join(several, ["digest", "row_hash"], "left_anti").unionByName(once)
    return plain.unionByName(left).select("row.*")
