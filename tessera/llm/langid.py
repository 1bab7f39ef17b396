"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of order 3 with escape method C: P(byte | context) = count / (total + distinct), the
escape costs distinct / (total + distinct) and leads to the next shorter context, down to 1/256 for each byte. The
trees are frozen after training. A text's code length in a language is the exact sum over all its bytes; the shortest
one wins, ties to the smaller language value. score is the posterior 1 / sum(2 ** (shortest - length)).

Training reads a bounded sample of labelled documents, whole ones: of every language those with the smallest hashes of
doc_id and text, each text once, about `sample_docs` of them and about `sample_bytes` bytes, less where the languages together would pass
TOTAL_BYTES, and always at least the first. Context counts are made in tasks; the trees, which the sample bounds, are built on
the driver and broadcast. Prediction reads whole texts, in pieces, and nothing but them; its work grows with the number of languages.

Defined results: a null text, or one without a letter, is `und` with score 0; so is everything if nothing was learned.
Repeated rows are predicted each for itself; a null doc_id is a document like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_list, cut, free_name, small_batches, table

SAMPLE_DOCS, SAMPLE_BYTES = 500, 4 << 20
#: Sampled bytes of all languages together, about; bounds the trees.
TOTAL_BYTES = 64 << 20
#: Bytes of text that are scored at once.
PIECE = 1 << 20
#: Bits a byte above which a document is taken for no language at all (a filter's parameter, not op9's).
REJECT_BITS = 7.0
ORDER = 3
UND = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def byte_strings(d: np.ndarray, n: int) -> np.ndarray:
    """The strings of n bytes in d, at most four, as big-endian numbers."""
    out = d[: max(0, len(d) - n + 1)].astype(np.uint32)
    for i in range(1, n):
        out = out << np.uint32(8) | d[i : len(d) - n + 1 + i]
    return out


def string_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of four bytes that end in the texts, each between line feeds, and how often each comes."""
    found = [byte_strings(np.frombuffer(b"\n\n\n" + t + b"\n\n\n", np.uint8), 4) for t in texts]
    return np.unique(np.concatenate(found) if found else np.empty(0, np.uint32), return_counts=True)


def escapes(counts: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of counted bytes in their contexts, and of leaving each context (0 where it was never seen)."""
    total, kinds = np.bincount(context, counts, contexts), np.bincount(context, minlength=contexts)
    leave = np.where(total > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
    return np.log2((total + kinds)[context]) - np.log2(counts), leave


class Tree:
    """One language's frozen order-3 context tree: bits of the byte strings it saw, and of leaving their contexts.

    Strings of three and four bytes are sorted lists with the bits of the last byte after the others; what depends on two
    bytes or fewer is dense.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray):
        def shorter(s: np.ndarray, n: np.ndarray, mask: int, first: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
            # the suffixes, and those of the line feeds before the first text
            out, at = np.unique(np.append(s & np.uint32(mask), np.uint32(first[0])), return_inverse=True)
            return out, np.bincount(at, np.append(n, first[1]))

        n4 = counts.astype(float)
        s3, n3 = shorter(strings, n4, 0xFFFFFF, (0x0A0A0A, 1))
        s2, n2 = shorter(s3, n3, 0xFFFF, (0x0A0A, 1))
        s1, n1 = shorter(s2, n2, 0xFF, (0x0A, 1))
        kinds = len(s1)
        cost1 = np.full(256, np.log2(n1.sum() + kinds) - np.log2(kinds / 256))
        cost1[s1] = np.log2(n1.sum() + kinds) - np.log2(n1 + kinds / 256)
        bits2, leave1 = escapes(n2, s2 >> 8, 256)
        cost2 = leave1[:, None] + cost1
        cost2.reshape(-1)[s2] = bits2
        self.cost2 = cost2.reshape(-1).astype(np.float32)
        bits3, leave2 = escapes(n3, s3 >> 8, 65536)
        contexts, at = np.unique(strings >> np.uint32(8), return_inverse=True)
        bits4, leave3 = escapes(n4, at, len(contexts))
        self.leave2 = leave2.astype(np.float32)
        self.s3, self.bits3 = s3, bits3.astype(np.float32)
        self.s4, self.bits4 = strings, bits4.astype(np.float32)
        self.contexts, self.leave3 = contexts, leave3.astype(np.float32)

    def bits(self, s: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of four bytes after its others, escapes included; s is sorted."""
        out, new = found(self.s4, self.bits4, s)
        s = s[new]
        leave, _ = found(self.contexts, self.leave3, s >> np.uint32(8))
        low, new3 = found(self.s3, self.bits3, s & np.uint32(0xFFFFFF))
        t = s[new3]
        low[new3] = self.leave2[t >> np.uint32(8) & np.uint32(0xFFFF)] + self.cost2[t & np.uint32(0xFFFF)]
        out[new] = leave + low
        return out


def found(strings: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of wanted strings (0 where there is none), and the places of those that there are not."""
    if not len(strings):
        return np.zeros(len(wanted)), np.arange(len(wanted))
    at = np.minimum(np.searchsorted(strings, wanted), len(strings) - 1)
    there = strings[at] == wanted
    return np.where(there, values[at], 0.0), np.flatnonzero(~there)


class ContextTrees:
    """The trees of all languages."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.trees = {k: Tree(*string_counts(texts[k])) for k in sorted(texts)}

    @classmethod
    def of_counts(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> ContextTrees:
        out = cls({})
        out.trees = {k: Tree(*counts[k]) for k in sorted(counts)}
        return out

    @property
    def languages(self) -> list[str]:
        return list(self.trees)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language: each different string of a piece is looked up once for every language."""
        out = np.zeros((len(texts), len(self.trees)))
        for owners, data in self.pieces(texts):
            strings, at = np.unique(data, return_inverse=True)
            for j, tree in enumerate(self.trees.values()):
                out[:, j] += np.bincount(owners, tree.bits(strings)[at], len(texts))
        return out

    @staticmethod
    def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts' numbers and the strings of four bytes that end in them, for about PIECE bytes of the texts at a time."""
        held, size = [], 0
        for i, t in enumerate(texts):
            for start in range(0, len(t), PIECE):
                part = (b"\n\n\n" + t[:PIECE]) if not start else t[start - 3 : start + PIECE]
                held.append((i, byte_strings(np.frombuffer(part, np.uint8), 4)))
                size += len(held[-1][1])
                if size >= PIECE:
                    yield np.repeat([x for x, _ in held], [len(y) for _, y in held]), np.concatenate([y for _, y in held])
                    held, size = [], 0
        if held:
            yield np.repeat([x for x, _ in held], [len(y) for _, y in held]), np.concatenate([y for _, y in held])


COUNTS = pa.schema([("lang", pa.string()), ("string", pa.int64()), ("n", pa.int64())])


def context_counts(sample: DataFrame) -> DataFrame:
    """lang, string (of four bytes), n over the documents (lang, text); a task's counts are taken together before the shuffle."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), binary_list(b.column(1)), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, mine in texts.items():
                strings, n = string_counts(mine)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(strings), pa.string()), pa.array(strings.astype(np.int64)), pa.array(n.astype(np.int64))], schema=COUNTS)

    return sample.mapInArrow(run, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, keep: Column | None = None) -> ContextTrees:
    """Trees of all languages in docs' labelled rows (those where keep holds)."""
    small_batches(docs.sparkSession)
    unit = F.xxhash64("doc_id", "text", F.lit(11)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (keep if keep is not None else F.lit(True)))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), unit.alias("unit"))
    sizes = cut(labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("unit").alias("least")), "language-sizes")
    most = min(sample_bytes, TOTAL_BYTES / max(1, sizes.count()))
    share = F.least(F.lit(float(sample_docs)) / F.col("n"), F.lit(float(most)) / F.greatest("bytes", F.lit(1)))
    picked = labelled.join(sizes.select("lang", "least", share.alias("share")), "lang").where((F.col("unit") < F.col("share")) | (F.col("unit") == F.col("least")))
    counts = context_counts(picked.select("lang", "text").distinct()).orderBy("lang", "string").toArrow()
    lang, string, n = (counts.column(c).combine_chunks() for c in COUNTS.names)
    names = lang.dictionary_encode()
    of = names.indices.to_numpy()
    return ContextTrees.of_counts({k: (string.to_numpy()[of == i].astype(np.uint32), n.to_numpy()[of == i]) for i, k in enumerate(names.dictionary.to_pylist())})


FOUND = pa.schema([("pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """docs with one more column, the last: a struct of pred, score and bits (bits a byte in the predicted language). It
    is called `language`, or a variant of that where docs has such a column."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees)
    inner = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in it:
            if not b.num_rows:
                continue
            texts = [t if ok and t is not None else b"" for t, ok in zip(binary_list(b.column("text")), b.column("letter").to_pylist(), strict=True)]
            n = len(trees.languages)
            bits = trees.lengths(texts) if n else np.zeros((len(texts), 0))
            pred, score, rate = [], [], []
            for t, x in zip(texts, bits, strict=True):
                best = int(np.argmin(x)) if t and n else -1
                pred.append(trees.languages[best] if best >= 0 else UND)
                score.append(float(1 / np.exp2(np.maximum(x[best] - x, -1000)).sum()) if best >= 0 else 0.0)
                rate.append(float(x[best]) / len(t) if best >= 0 else None)
            found = pa.StructArray.from_arrays([pa.array(v, k.type) for v, k in zip((pred, score, rate), FOUND, strict=True)], names=FOUND.names)
            yield pa.RecordBatch.from_arrays([b.column("row"), found], names=["row", "found"])

    kind = T.StructType([T.StructField("row", inner.schema["row"].dataType), T.StructField("found", T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]))])
    return inner.mapInArrow(run, kind).select("row.*", F.col("found").alias(free_name(docs, "language")))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language; documents whose crc32(doc_id) mod 4 is 2 are never learned from."""
    docs = table(spark, sf_dir, "documents")
    trees = train(docs.select("doc_id", "text", "lang"), keep=~held_out(F.col("doc_id")))
    out = predict(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.pred").alias("lang_pred"), "language.score", "language.bits")
