"""Quality selection by importance resampling.

Texts become counts of hashed word unigrams and bigrams. One multinomial model is fitted to target text (documents
labelled good and not toxic), one to the raw corpus; a document's log importance weight is the sum of log p_target -
log p_raw over its n-grams. Adding Gumbel noise and keeping the k largest keys samples k documents without replacement
in proportion to their weights. The noise hangs on doc_id and a seed alone, so reruns agree.

The raw model counts every n-gram of every document. The target model is fitted to at most about `max_target` labelled
documents, those with the smallest hashes of doc_id. k is a share of all documents. The k-th largest key is found by
counting in ever finer bins, never by collecting keys.

Defined results: a null or empty text has no n-gram and weight 0, its key is the noise alone; rows tied with the k-th
key are all kept; a repeated doc_id gets the same noise in every row; no labelled target leaves all weights 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_list, cut, small_batches, table

BUCKETS = 1 << 16
MAX_TARGET = 20_000
KEEP_SHARE = 0.85
SMOOTHING = 1.0
#: Words whose hashes a worker keeps; beyond it the memory starts anew.
WORD_CACHE = 400_000


class Hasher:
    """Bucket numbers of the word unigrams and bigrams of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.words = buckets, {}

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams of the texts in a row, and the number of each text."""
        from xxhash import xxh64_intdigest

        if len(self.words) > WORD_CACHE:
            self.words.clear()
        known, out, sizes = self.words, [], []
        for t in texts:
            words = t.lower().split()
            for w in words:
                if w not in known:
                    known[w] = xxh64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[:-1] >> np.uint64(29)))
            pairs *= np.uint64(0xBF58476D1CE4E5B9)
            out += [h >> np.uint64(40), pairs >> np.uint64(40)]
            sizes.append(len(h) + len(pairs))
        flat = np.concatenate(out) if out else np.empty(0, np.uint64)
        return (flat % np.uint64(self.buckets)).astype(np.int64), np.array(sizes, np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n_target, n_raw over docs (text, is_target): one row for each bucket and task before the shuffle."""
    schema = pa.schema([("bucket", pa.int32()), ("t", pa.int64()), ("r", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, target, raw = Hasher(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in it:
            flat, sizes = hasher.features([t or b"" for t in binary_list(b.column(0))])
            raw += np.bincount(flat, minlength=buckets)
            good = np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(bool), sizes)
            target += np.bincount(flat[good], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(target[used]), pa.array(raw[used])], schema=schema)

    rows = docs.select("text", "is_target").mapInArrow(run, "bucket int, t long, r long")
    return rows.groupBy("bucket").agg(F.sum("t").alias("n_target"), F.sum("r").alias("n_raw"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target - log p_raw of every bucket; at most `buckets` rows come to the driver."""
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r in counts.collect():
        target[r["bucket"]], raw[r["bucket"]] = r["n_target"], r["n_raw"]
    if not target.any():
        return np.zeros(buckets)
    p = lambda c: np.log((c + smoothing) / (c.sum() + smoothing * buckets))
    return p(target) - p(raw)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_features, log_weight."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("log_weight", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        hasher = Hasher(len(ratios))
        for b in it:
            flat, sizes = hasher.features([t or b"" for t in binary_list(b.column(1))])
            w = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ratios[flat], len(sizes))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(np.asarray(w, float))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_features long, log_weight double")


def gumbel(doc_id: Column, seed: int) -> Column:
    u = (F.xxhash64(doc_id, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, by counts in bins: each pass settles the rank within 1024 bins."""
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return lo
    above = 0
    while lo < hi:
        width = (hi - lo) / 1024
        if lo + width <= lo or hi - width >= hi:
            width = 0.0
        inside = rows.where((F.col(column) >= F.lit(lo)) & (F.col(column) <= F.lit(hi)))
        bin_ = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023)) if width else F.lit(0)
        bins = {r["b"]: r for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        if len(bins) == 1 and next(iter(bins.values()))["n"] <= 64 or not width:
            values = sorted((r[0] for r in inside.select(column).distinct().orderBy(F.desc(column)).limit(1024).collect()), reverse=True)
            for v in values:
                above += inside.where(F.col(column) == v).count()
                if above >= k:
                    return v
        for b in sorted(bins, reverse=True):
            if above + bins[b]["n"] >= k:
                lo, hi = bins[b]["lo"], bins[b]["hi"]
                break
            above += bins[b]["n"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE, max_target: int = MAX_TARGET, seed: int = 17) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key, keep for every row of docs; labels: doc_id, quality, toxic."""
    small_batches(docs.sparkSession)
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"))
    n = good.count()
    unit = F.xxhash64("l_id", F.lit(23)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    # about max_target ids by hash, and hard-bounded: small enough to send to every executor
    picked = good.where(unit < (max_target / n if n > max_target else 2.0)).limit(2 * max_target).distinct()
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"), "left").withColumn("is_target", F.col("l_id").isNotNull())
    ratios = log_ratios(bucket_counts(marked))
    rows = cut(weigh(docs.select("doc_id", F.col("text").cast("string").alias("text")), ratios).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "importance-keys")
    least = kth_largest(rows, "gumbel_key", int(-(-rows.count() * keep_share // 1)))
    return rows.withColumn("keep", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and Gumbel keys of all documents, and which of them the resampled corpus keeps."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
