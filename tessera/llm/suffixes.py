"""Substring removal by bytes with suffix arrays: bytes covered by a 100-byte string that also starts earlier go.

The texts that `passages` lets meet are laid into blocks. A block's suffix array is built in two
stages: only suffixes smaller than their successors are sorted, by eight bytes at a time and no deeper than a window;
the others are induced by one scan over the buckets of first bytes, since such a suffix is its byte before a suffix
already placed. Neighbours whose common prefix spans a window form classes; all but the earliest member under a key
repeat.

Defined results: a null text is empty; texts shorter than a window keep all bytes; several texts under one doc_id are
ordered by a hash of the text, and equal ones are one document whose rows all get its result; null ids come first; an
empty table gives an empty result; other columns stay in the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .passages import Bytes, Sums, without_repeats

UNIT = Bytes()
#: Depth at which suffixes that agree so far are tried for going on alike.
LIKELY = 24


def eight_bytes(data: bytes) -> np.ndarray:
    """The big-endian numbers at every place of data, which is padded."""
    return np.ndarray((len(data) - 7,), ">u8", data, 0, (1,)).astype(np.uint64)


def suffix_order(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of data ordered by at least their first `depth` bytes."""
    n = len(data)
    t = np.frombuffer(data, np.uint8)
    padded = data + bytes(depth + 16)
    words = eight_bytes(padded)
    sums = Sums(np.frombuffer(padded, np.uint8) + np.uint64(1)) if depth > LIKELY else None
    step = np.flatnonzero(t[:-1] != t[1:])
    after = np.append(step, n)[np.cumsum(np.append(0, t[:-1] != t[1:]))] if n else np.empty(0, np.int64)
    smaller = np.zeros(n, bool)
    inner = after < n
    smaller[inner] = t[after[inner]] < t[after[inner] + 1]
    # stage one: sort those smaller than their successors
    b = np.flatnonzero(smaller)
    key = words[b]
    order = np.argsort(key, kind="stable")
    b, key = b[order], key[order]
    head = np.append(True, key[1:] != key[:-1]) if len(b) else np.empty(0, bool)
    group = np.maximum.accumulate(np.where(head, np.arange(len(b)), 0)) if len(b) else np.empty(0, np.int64)
    done = np.zeros(len(b), bool)
    for deep in range(8, depth, 8):
        alone = head & np.append(head[1:], True) if len(head) else head
        alone |= done
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        if deep == LIKELY:  # groups that go on alike to the end, by a hash of it, are in order: most of the repeats
            rest = sums.of(b[live] + deep, b[live] + depth + 8)
            start = np.append(True, group[live][1:] != group[live][:-1])
            number = np.cumsum(start) - 1
            unlike = np.bincount(number, np.append(False, rest[1:] != rest[:-1]) & ~start) > 0
            done[live] = ~unlike[number]
            live = live[unlike[number]]
        key, own = words[b[live] + deep], group[live]
        start = np.append(True, own[1:] != own[:-1])
        # a group whose members go on alike keeps its order; repeats are mostly of that kind
        number = np.cumsum(start) - 1
        unlike = np.bincount(number, np.append(False, key[1:] != key[:-1]) & ~start) > 0
        at = np.flatnonzero(unlike[number])
        order = np.lexsort((key[at], number[at]))
        b[live[at]], key[at] = b[live[at]][order], key[at][order]
        new = start | np.append(True, key[1:] != key[:-1])
        head[live] = new
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
    # stage two: induce the rest, bucket by bucket
    direct = np.split(b, np.searchsorted(t[b], np.arange(1, 256)))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        induced[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        whole = [front]
        while len(front):  # runs of the byte itself
            before = front[front > 0] - 1
            front = before[(t[before] == c) & ~smaller[before]]
            whole.append(front)
        bucket = np.concatenate([*whole, direct[c]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (t[before] != c)]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            at = np.append(True, first[1:] != first[:-1]).nonzero()[0]
            for x, part in zip(first[at], np.split(before, at[1:]), strict=True):
                induced[x].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def solve_block(keys: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first window, windows) of windows equal to one of an earlier segment or an earlier one of their own."""
    w = UNIT.window
    none = np.empty(0, np.int64)
    data = b"\0".join(texts)
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    segment = np.repeat(np.arange(len(texts)), sizes + 1)[: len(data)]
    place = np.arange(len(data)) - starts[segment]
    valid = place < counts[segment]
    order = suffix_order(data, w)
    order = order[valid[order]]
    words = eight_bytes(data + bytes(w + 16))
    # adjacent common prefixes, compared eight bytes at a time while they agree, the last ones first
    pairs = np.arange(1, len(order))
    for deep in [w - 8, *range(0, w - 8, 8)]:
        pairs = pairs[words[order[pairs] + deep] == words[order[pairs - 1] + deep]]
    joined = np.zeros(len(order), bool)
    joined[pairs] = True
    if not len(pairs):
        return none, none, none
    # segments lie in document order under each key, so places in the block do; a class counts for each key by itself
    several = joined | np.append(joined[1:], False)
    places = order[several]
    owner = np.cumsum(np.append(False, keys[1:] != keys[:-1]))[segment[places]]
    bits = [int(x.max()).bit_length() for x in (owner, places)]
    under = np.cumsum(~joined)[several].astype(np.uint64) << np.uint64(bits[0]) | owner.astype(np.uint64)
    if len(order).bit_length() + sum(bits) <= 64:  # one number holds class, key and place
        both = np.sort(under << np.uint64(bits[1]) | places.astype(np.uint64))
        places, under = (both & np.uint64((1 << bits[1]) - 1)).astype(np.int64), both >> np.uint64(bits[1])
    else:
        by = np.lexsort((places, under))
        places, under = places[by], under[by]
    repeated = np.sort(places[np.append(False, under[1:] == under[:-1])])
    if not len(repeated):
        return none, none, none
    run = np.append(True, (np.diff(repeated) != 1) | (segment[repeated][1:] != segment[repeated][:-1]))
    at = np.flatnonzero(run)
    return segment[repeated[at]], place[repeated[at]], np.diff(np.append(at, len(repeated)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes kept of all documents."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), UNIT, solve_block)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows in DuckDB: every window as text, the later of equal ones, and what they cover.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT doc_id, i, b[i:i + 99] AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
repeats AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
bytes AS (SELECT doc_id, hex(b[j:j]) AS x, j FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS j FROM d)),
marked AS (SELECT doc_id, j, x, coalesce(j - max(i) OVER (PARTITION BY doc_id ORDER BY j) < 100, false) AS gone
           FROM bytes LEFT JOIN (SELECT doc_id, i AS j, i FROM repeats) USING (doc_id, j)),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM marked),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY j) FILTER (NOT gone) AS x FROM edges GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
