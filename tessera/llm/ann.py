"""Approximate nearest neighbours by inner product: a robust-pruned directed graph in every shard.

Rows are dealt to shards by a hash of vec_id; as many shards as the cluster runs tasks, more where a shard would pass
SHARD_ROWS. Inner product becomes Euclidean distance by one more coordinate sqrt(M^2 - |x|^2), M the longest norm of the
shard. A graph is grown from a few seeds in rounds that double it: a beam search through the graph so far proposes each
new point's neighbours, relaxed pruning (keep the nearest, drop what a kept one is alpha times nearer to, repeat) keeps
a diverse few, and backward edges are pruned alike. All points of a round are searched together, as matrix operations.

Rows with one and the same vector are one point of the graph, and are all found with it.

Every query beams through every shard's graph; its shard answers are merged by rank, so only k rows for each query
and shard are shuffled. A shard no larger than a beam is scanned. The score is the inner product of the original
vectors in double precision.

Defined results: vectors null, empty, all zero or holding null or non-finite components take no part, nor do those of
another length than the most frequent one (ties: the shorter); a query finds all candidates if there are fewer than k.
Rows of one vec_id are one candidate, at the best of their scores, and one query, with the first of their vectors in
component order; none of them is among that query's answers. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, open_store, small_batches, table, work_dir

K = 20
#: Vectors of a shard; recall was measured at this size, and falls in larger shards.
SHARD_ROWS = 8_000
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Width of the beam that answers queries.
QUERY_BEAM = 128
#: Points searched together; bounds the work memory of a search.
TOGETHER = 512
#: Queries that a shard task reads and answers at a time.
QUERY_BLOCK = 4096


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


class Graph:
    """A directed graph over points, searched by beams; all distances are squared and Euclidean."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.points = np.hstack([vectors, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))[:, None]]).astype(np.float32)
        self.sq = np.einsum("ij,ij->i", self.points, self.points)
        self.degree, self.beam, self.alpha = degree, beam, alpha * alpha
        n = len(vectors)
        self.out = np.full((n, degree), -1, np.int32)
        self.count = np.zeros(n, np.int32)
        order = np.random.default_rng(7).permutation(n)
        first = min(n, 2 * degree)
        seed = order[:first]
        self.entry = seed[:1]
        if n:
            centre = self.points.mean(0)
            self.entry = seed[np.argsort(((self.points[seed] - centre) ** 2).sum(1))[: max(1, degree // 4)]].astype(np.int64)
        for p in seed:
            self.set_edges(p, self.prune(p, seed[seed != p]))
        self.link_back(seed)
        done = first
        while done < n:
            step = order[done : done + max(1, min(done, 4096))]
            for i in range(0, len(step), TOGETHER):
                part = step[i : i + TOGETHER]
                found = self.search(self.points[part], beam)[0]
                for p, near in zip(part, found, strict=True):
                    self.set_edges(p, self.prune(p, near[near >= 0]))
            self.link_back(step)
            done += len(step)

    def set_edges(self, p: int, edges: np.ndarray) -> None:
        self.out[p, : len(edges)], self.out[p, len(edges) :], self.count[p] = edges, -1, len(edges)

    def prune(self, p: int, candidates: np.ndarray) -> np.ndarray:
        """At most `degree` of the candidates, all different: nearest first, without those that a kept one is alpha times nearer to."""
        c = candidates[candidates != p]
        if not len(c):
            return c
        x = self.points[c]
        d = self.sq[c] + self.sq[p] - 2 * (x @ self.points[p])
        order = np.argsort(d, kind="stable")
        c, x, d = c[order], x[order], d[order]
        between = (self.sq[c][:, None] + self.sq[c][None, :] - 2 * (x @ x.T)) * self.alpha
        alive, kept = np.ones(len(c), bool), []
        for i in range(len(c)):
            if alive[i]:
                kept.append(i)
                if len(kept) == self.degree:
                    break
                alive &= between[i] > d
        return c[kept]

    def link_back(self, new: np.ndarray) -> None:
        """Edges from their neighbours back to new points, where they are missing; lists that overflow are pruned."""
        heads = np.repeat(new, self.count[new])
        tails = self.out[new][self.out[new] >= 0]
        if not len(tails):
            return
        order = np.argsort(tails, kind="stable")
        tails, heads = tails[order], heads[order]
        at = np.flatnonzero(np.diff(tails, prepend=-1))
        for t, h in zip(tails[at], np.split(heads, at[1:]), strict=True):
            old = self.out[t, : self.count[t]]
            both = np.concatenate([old, h[~np.isin(h, old)]])
            self.set_edges(t, both if len(both) <= self.degree else self.prune(t, both))

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nearest found points of every query (-1 past the end) and their distances, nearest first."""
        q = np.ascontiguousarray(queries, np.float32)
        m, rows = len(q), np.arange(len(q))
        qq = np.einsum("ij,ij->i", q, q)
        start = self.entry[:beam]
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        ids[:, : len(start)] = start
        dist[:, : len(start)] = self.sq[start] + qq[:, None] - 2 * (q @ self.points[start].T)
        order = np.argsort(dist, 1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        open_ = ids >= 0
        seen = np.zeros((m, (len(self.points) + 7) // 8), np.uint8)
        for s in start:
            seen[:, s >> 3] |= np.uint8(1 << (s & 7))
        wide = 4  # points of a beam opened at once
        active = rows
        while len(active):
            pick = np.argsort(~open_[active], 1, kind="stable")[:, :wide]
            live = np.take_along_axis(open_[active], pick, 1)
            here = np.where(live, np.take_along_axis(ids[active], pick, 1), -1)
            open_[active[:, None], pick] = False
            near = np.where((here >= 0)[:, :, None], self.out[here], -1).reshape(len(active), -1).astype(np.int64)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            bit = (1 << (near & 7)).astype(np.uint8)
            old = (seen[active[:, None], near >> 3] & bit) > 0
            near[old & (near >= 0)] = -1
            r, c = np.nonzero(near >= 0)
            np.bitwise_or.at(seen, (active[r], near[r, c] >> 3), bit[r, c])
            d = np.full(near.shape, np.inf, np.float32)
            pts = near[r, c]
            d[r, c] = self.sq[pts] + qq[active[r]] - 2 * np.einsum("ij,ij->i", self.points[pts], q[active[r]])
            all_d = np.hstack([dist[active], d])
            all_i = np.hstack([ids[active], near])
            all_o = np.hstack([open_[active], np.isfinite(d)])
            best = np.argsort(all_d, 1, kind="stable")[:, :beam]
            dist[active], ids[active], open_[active] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_i, best, 1), np.take_along_axis(all_o, best, 1)
            active = active[open_[active].any(1)]
        ids[~np.isfinite(dist)] = -1
        return ids, dist


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id long, vec_id long, score double"


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Shard:
    """A shard's graph over its distinct vectors, each with the ids that have it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        _, first, of = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).reshape(-1), return_index=True, return_inverse=True)
        order = np.lexsort((ids, of))
        self.vectors, self.ids = vectors[first], ids[order]
        self.count = np.bincount(of, minlength=len(first))
        self.start = np.cumsum(self.count) - self.count
        self.graph = Graph(self.vectors)

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
        """The k best candidates for each query, scored exactly; of rows with one vector the smallest ids come first, so k + 1 of them do."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        beam = max(QUERY_BEAM, 3 * k)
        every = np.arange(len(self.vectors)) if len(self.vectors) <= beam else None
        for i in range(0, len(queries), TOGETHER):
            q = queries[i : i + TOGETHER]
            found = self.graph.search(np.hstack([q, np.zeros((len(q), 1))]), beam)[0] if every is None else [every] * len(q)
            for qid, x, near in zip(query_ids[i : i + TOGETHER], q, found, strict=True):
                near = near[near >= 0]
                n = np.minimum(self.count[near], k + 1)
                ids = self.ids[np.repeat(self.start[near] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                score = np.repeat((self.vectors[near] * x).sum(1), n)
                top = np.lexsort((ids, -score))
                top = top[ids[top] != qid]
                top = top[np.sort(np.unique(ids[top], return_index=True)[1])][:k]  # an id once, at its best score
                out.append((np.full(len(top), qid), ids[top], score[top]))
        parts = [np.concatenate([o[j] for o in out]) if out else np.empty(0) for j in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, FOUND, strict=True)], schema=FOUND)


def nearest(rows: DataFrame, is_query, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the rows where is_query holds, against all rows.

    Shard tasks read the stated query set in blocks from its table in the shared folder, not through the driver.
    """
    spark = rows.sparkSession
    small_batches(spark)
    good = cut(usable(rows).dropDuplicates(), "ann-vectors")
    count = good.count()
    shards = max(1, min(spark.sparkContext.defaultParallelism, count // 500 + 1), -(-count // shard_rows))
    path = work_dir(spark, "ann-queries")
    good.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).write.parquet(path)
    shard = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).cast("int")
    rows = good.select(shard.alias("shard"), "vec_id", "embedding")
    # a task for each shard: the shard's number is the partition's
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "vec_id")

    def answers(own: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        mine = Shard(np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own]))
        store, folder = open_store(path)
        for b in ds.dataset(folder, filesystem=store, format="parquet", exclude_invalid_files=False).to_batches(columns=["vec_id", "embedding"], batch_size=QUERY_BLOCK):
            if b.num_rows:
                yield mine.answer(b.column(0).to_numpy(), matrix(b.column(1)), k)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for b in it:
            shard_of = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if own and shard_of[lo] != at:
                    yield from answers(own)
                    own = []
                at, part = shard_of[lo], b.slice(lo, hi - lo)
                own.append((part.column("vec_id").to_numpy(), matrix(part.column("embedding"))))
        if own:
            yield from answers(own)

    found = dealt.mapInArrow(run, FOUND_DDL)
    # a query's answers are at most k rows for each shard
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20, among all others."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
