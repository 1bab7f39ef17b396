"""Packing by power-of-two decomposition: a document of n tokens is cut into pieces of 2048 and of the binary digits of
the rest, longest first. Every piece is a sequence of its own and falls into the bucket of its length, so nothing is
padded and no sequence crosses documents. Buckets are folders of a Parquet table, one for each length, so a training
run reads batches of equal sequences. No shuffle: sequence ids are the task's number and a counter within it.

Defined results: a null text is an empty one and still has the end token; repeated rows are packed each for itself with
sequences of their own; an empty table packs to nothing. Texts are encoded whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_list, small_batches, table, work_dir

MAX_LENGTH = 2048
END_ID = 1
#: Words, and bytes of words, whose encodings a worker keeps; beyond either the memory of words starts anew.
WORD_CACHE, CACHE_BYTES = 500_000, 32 << 20
#: Marks that may close a word of letters; a run of them is one part of the vocabulary file's splits.
CLOSING = string.punctuation
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIndex(dict):
    """Words by number; a word asked for the first time gets the next one and is put on `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordEncoder:
    """Token ids of whole texts, through a memory of the ids of words between ASCII blanks.

    The vocabulary file drops white space and case, and its splits and normal forms never look across white space, so a
    text's ids are those of its words in a row. New words that are letters with closing punctuation, which the file
    splits in a known way, are encoded many at once: each part ends with one id that ends a word. Others go singly.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.index, self.held = WordIndex(), 0
        self.index[None], self.index[b""] = 0, 1  # the end of a text; the nothing beside outer blanks
        self.flat, self.starts, self.counts = np.array([self.end_id], np.uint32), np.array([0, 1], np.int64), np.array([1, 0], np.int64)

    def learn(self, fresh: list[bytes]) -> None:
        """Append the ids of fresh words."""
        import numpy as np

        words = pa.array(fresh, pa.binary()).cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
        core = pc.ascii_rtrim(words, CLOSING)
        plain = np.asarray(pc.ascii_is_alpha(core))
        parts = 1 + np.asarray(pc.not_equal(pc.binary_length(words), pc.binary_length(core))).astype(np.int64)
        for i in np.flatnonzero(~plain & np.asarray(pc.invert(pc.string_is_ascii(words)))):
            plain[i] = fresh[i].decode("utf-8", "replace").rstrip(CLOSING).lower().isalpha()
        joined = b" ".join([fresh[i] for i in np.flatnonzero(plain)]).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != parts[plain].sum():  # a split that was not foreseen: all go singly
            plain[:], ids, stops = False, ids[:0], stops[:0]
        singly = np.flatnonzero(~plain)
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([fresh[i].decode("utf-8", "replace") for i in singly], add_special_tokens=False)]
        lengths = np.empty(len(fresh), np.int64)
        lengths[plain] = np.diff(np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(parts[plain])])])
        lengths[singly] = [len(x) for x in found]
        at = np.empty(len(fresh), np.int64)
        for part, base in ((plain, 0), (singly, len(ids))):
            at[part] = base + np.cumsum(lengths[part]) - lengths[part]
        self.starts = np.concatenate([self.starts, len(self.flat) + at])
        self.counts = np.concatenate([self.counts, lengths])
        self.flat = np.concatenate([self.flat, ids, *found])
        self.held += sum(map(len, fresh))

    def encode(self, texts: pa.Array) -> tuple:
        """The ids of all texts (strings, null: empty) in a row, each text's followed by the end id, and their numbers.

        Arrow splits the batch and numbers its different words, so only those are looked up one by one."""
        import numpy as np

        if len(self.index) > WORD_CACHE or self.held > CACHE_BYTES:
            self.clear()
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.flatten().dictionary_encode()
        # one split instead of a value for each word
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_buffer().to_pybytes().split(b" ")
        known = np.fromiter(map(self.index.__getitem__, names), np.int32, len(names))
        if self.index.fresh:
            self.learn(self.index.fresh)
            self.index.fresh = []
        stops = np.asarray(split.offsets)[1:]
        word = np.insert(known[np.asarray(coded.indices)], stops, 0)
        first = self.starts[word]
        count = self.counts[word]
        ends = np.cumsum(count)
        flat = self.flat[np.arange(ends[-1]) + np.repeat(first - ends + count, count)]
        return flat, np.diff(ends[stops + np.arange(len(stops))], prepend=0)


#: Encoders of this worker by vocabulary and end id; tasks that follow each other share what was learned.
ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in ENCODERS:
        ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return ENCODERS[path, end_id]


def pieces(counts, most: int = MAX_LENGTH) -> tuple:
    """document, start and length of the pieces of documents of so many tokens, in order."""
    import numpy as np

    digits = most.bit_length() - 1
    whole = counts // most
    sizes = np.hstack([whole[:, None], (counts % most)[:, None] >> np.arange(digits - 1, -1, -1) & 1])
    length = np.repeat(np.tile([most, *(1 << np.arange(digits - 1, -1, -1))], len(counts)), sizes.reshape(-1))
    document = np.repeat(np.arange(len(counts)), sizes.sum(1))
    start = np.cumsum(length) - length
    return document, start - np.repeat(np.cumsum(counts) - counts, sizes.sum(1)), length


def pack(docs: DataFrame, vocabulary: str | None = None, most: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset. `length` is the bucket."""
    path = vocabulary or default_vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from pyspark import TaskContext

        words, next_id = encoder(path, end_id), TaskContext.get().partitionId() << 40
        for b in it:
            if not b.num_rows:
                continue
            flat, counts = words.encode(b.column(1))
            document, start, length = pieces(counts, most)
            n = len(length)
            bounds = np.concatenate([[0], np.cumsum(4 * length)])
            ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())
            columns = [b.column(0).take(pa.array(document)), pa.array(start), pa.array(length), ids, pa.array(counts[document]), pa.array(np.arange(next_id, next_id + n)), pa.array(np.zeros(n, np.int64))]
            next_id += n
            yield pa.RecordBatch.from_arrays(columns, schema=SCHEMA)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DDL)


def write_buckets(pieces: DataFrame, path: str) -> DataFrame:
    """Write pieces by length, a folder for each; all of a task's buckets are open at once, so nothing is sorted. Returns the table."""
    spark, key = pieces.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "16")
    pieces.write.option("compression", "lz4").option("parquet.enable.dictionary", "false").partitionBy("length").parquet(path)
    spark.conf.set(key, before)
    return spark.read.schema(pieces.schema).parquet(path)


def op8_binary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into buckets; the ids of a piece are returned as their CRC-32."""
    return digest(write_buckets(pack(table(spark, sf_dir, "documents")), work_dir(spark, "buckets")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
