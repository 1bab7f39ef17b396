"""Substring removal by words with relative Lempel-Ziv parsing: words covered by a 20-word window that also starts earlier go.

The texts that `passages` lets meet under a key, in document order, are a reference block and what is factored against
it: the block of a document that others point to, or a key's earlier segments. The reference is indexed by window; each
next text is factored greedily against all of it: the longest match from a place on is a factor if it spans a window or
more. All windows inside a factor repeat; those across its end are looked up one by one, since they may occur elsewhere
in the reference. A text's new windows then join the reference.

Defined results: as in `suffixes`, with words for bytes; kept words are joined by one space, unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .passages import Words, without_repeats

UNIT = Words()


def factor(words: list[bytes], reference: dict[tuple[bytes, ...], tuple[list[bytes], int]], window: int) -> list[bool]:
    """Which windows of words occur in the reference (or earlier in words), which they join."""
    n = len(words) - window + 1
    repeated = [False] * n
    i = reach = 0  # windows before reach lie inside a factor
    while i < n:
        if i < reach:
            repeated[i] = True
            i += 1
            continue
        content = tuple(words[i : i + window])
        hit = reference.get(content)
        if hit is None:
            reference[content] = (words, i)
        else:
            block, at = hit
            length, most = window, min(len(words) - i, len(block) - at)
            while length < most and words[i + length] == block[at + length]:
                length += 1
            repeated[i] = True
            reach = i + length - window + 1
        i += 1
    return repeated


def solve_block(keys: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first window, windows) of windows equal to one of an earlier segment or an earlier one of their own."""
    segment, first, count = [], [], []
    reference: dict = {}
    last = None
    for i, (key, text) in enumerate(zip(keys.tolist(), texts, strict=True)):
        if key != last:
            reference, last = {}, key
        start = None
        for j, hit in enumerate([*factor(text.split(), reference, UNIT.window), False]):
            if hit and start is None:
                start = j
            elif not hit and start is not None:
                segment.append(i), first.append(start), count.append(j - start)
                start = None
    return tuple(np.array(x, np.int64) for x in (segment, first, count))


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs without repeated passages: a text that loses words becomes its other words, joined by one space; documents left without a word go."""
    out = without_repeats(docs, UNIT, solve_block).where("n_removed < n_units or n_units = 0")
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length(text).cast("long"))
    return out.select(*[c.alias(k) for k, c in columns.items()])


def op5_factor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of all documents."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), UNIT, solve_block)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB: every window as text, the later of equal ones, and what they cover.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
repeats AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
marked AS (SELECT doc_id, j, word, coalesce(j - max(i) OVER (PARTITION BY doc_id ORDER BY j) < 20, false) AS gone
           FROM words LEFT JOIN (SELECT doc_id, i AS j, i FROM repeats) USING (doc_id, j)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS words FROM marked GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
