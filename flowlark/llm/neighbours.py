"""Approximate nearest neighbours by robust-pruned directed graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved
from .vectors import lengths, matrix, valid

#: Distinct vectors in a shard, each with a graph of its own: at least and at most; between them there are MANY_SHARDS, so
#: that each query asks no more than these until the shards are full.
LEAST_ROWS, MOST_ROWS, MANY_SHARDS = 4096, 1 << 20, 64
#: Edges of a node, width of the beam that proposes neighbours and of that for queries, and how
#: much longer a way round may be for an edge to be left out.
DEGREE, BUILD_BEAM, QUERY_BEAM, RELAXED = 32, 64, 128, 1.2
#: Vectors that walk a graph at once, and how many marks of what they have met are held.
BATCH, MARKS = 256, 1 << 26


class Graph:
    """A directed graph over the rows of ``x`` (float), built by greedy search and robust pruning.

    Vectors are moved to their mean and scaled to at most 1, so that single precision serves for any finite ones;
    differences below a ten-millionth of the largest are lost on the way, not in the scores.
    """

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.large = np.abs(x).max(initial=0) or 1.0
        self.mean = (x / self.large).mean(0)
        self.spread = np.abs(x / self.large - self.mean).max(initial=0) or 1.0
        self.x = self._moved(x)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        n = len(x)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        self.start = int(((self.x - self.x.mean(0)) ** 2).sum(1).argmin())
        order = np.random.default_rng(seed).permutation(n)
        order = np.append(self.start, order[order != self.start])
        done = 1
        self.batch = max(1, min(BATCH, MARKS // max(n, 1)))
        while done < n:  # batches grow with the graph that they are searched in
            batch = order[done : done + min(self.batch, done)]
            found, distance = self._walk(self.x[batch], BUILD_BEAM, batch)
            self.edges[batch] = self.prune(batch, found, distance)
            self._back(batch)
            done += len(batch)

    def _moved(self, x: np.ndarray) -> np.ndarray:
        # What is further away than any use is cut off, as its squares wouldn't fit.
        return np.ascontiguousarray(np.clip((x / self.large - self.mean) / self.spread, -1e15, 1e15), np.float32)

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Ids of the ``beam`` nearest that a greedy walk meets, nearest first; -1 fills up."""
        return self._walk(self._moved(queries), beam)[0]

    def _walk(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        m, norm = len(queries), np.einsum("ij,ij->i", queries, queries)
        rows = np.arange(m)
        ids, far = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf, np.float32)
        ids[:, 0] = self.start
        far[:, 0] = norm + self.norm[self.start] - 2 * queries @ self.x[self.start]
        open_ = np.zeros((m, beam), bool)
        open_[:, 0] = True
        met = np.zeros((m, len(self.x)), bool)
        met[:, self.start] = True
        active = rows
        while len(active):
            at = np.where(open_[active], far[active], np.inf).argmin(1)
            open_[active, at] = False
            near = self.edges[ids[active, at]]
            new = (near >= 0) & ~met[active[:, None], near]
            r, c = np.nonzero(new)
            node = near[r, c]
            met[active[r], node] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = norm[active[r]] + self.norm[node] - 2 * np.einsum("ij,ij->i", queries[active[r]], self.x[node])
            all_ids = np.concatenate([ids[active], np.where(new, near, -1)], 1)
            all_far = np.concatenate([far[active], d], 1)
            all_open = np.concatenate([open_[active], new], 1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            part = np.arange(len(active))[:, None]
            ids[active], far[active], open_[active] = all_ids[part, keep], all_far[part, keep], all_open[part, keep]
            active = active[open_[active].any(1)]
        if own is not None:
            far[ids == own[:, None]] = np.inf
        order = np.argsort(far, axis=1)
        far = far[rows[:, None], order]
        return np.where(np.isinf(far), -1, ids[rows[:, None], order]), far

    def prune(self, nodes: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        """At most DEGREE of each node's candidates (nearest first): none that a chosen one is much closer to."""
        known = self.x[np.maximum(ids, 0)]
        norm = self.norm[np.maximum(ids, 0)]
        between = norm[:, :, None] + norm[:, None, :] - 2 * known @ known.transpose(0, 2, 1)
        alive = ids >= 0
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[some, k] = ids[rows, pick][some]
            covered = RELAXED * RELAXED * between[rows, pick] <= far
            alive &= ~covered
            alive[rows, pick] = False
        return out

    def _back(self, nodes: np.ndarray) -> None:
        """Edges back from the chosen neighbours, which are pruned again where they are too many."""
        src, k = np.nonzero(self.edges[nodes] >= 0)
        to, from_ = self.edges[nodes][src, k], nodes[src]
        order = np.argsort(to, kind="stable")
        to, from_ = to[order], from_[order]
        targets, first, many = np.unique(to, return_index=True, return_counts=True)
        for a in range(0, len(targets), BATCH):
            t, f, m = targets[a : a + BATCH], first[a : a + BATCH], many[a : a + BATCH]
            width = min(int(m.max()), 2 * DEGREE)
            col = np.arange(width)
            more = np.where(col < m[:, None], from_[np.minimum(f[:, None] + col, len(from_) - 1)], -1)
            ids = np.concatenate([self.edges[t], more], 1)
            far = self.norm[t][:, None] + self.norm[np.maximum(ids, 0)] - 2 * np.einsum("id,ijd->ij", self.x[t], self.x[np.maximum(ids, 0)])
            far[ids < 0] = np.inf
            o = np.argsort(far, axis=1)
            ids, far = np.take_along_axis(ids, o, 1), np.take_along_axis(far, o, 1)
            full = (ids >= 0).sum(1) > DEGREE
            self.edges[t[~full]] = ids[~full][:, :DEGREE]
            if full.any():
                self.edges[t[full]] = self.prune(t[full], ids[full], far[full])


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` from ``q``."""
    gap = np.abs(x - q)
    largest = gap.max(axis=1, initial=0)
    if (largest > 1e150).any() or ((largest > 0) & (largest < 1e-150)).any():  # whose squares don't fit
        with np.errstate(over="ignore"):
            whole = np.where((largest > 0) & np.isfinite(largest), largest, 1.0)
            return whole * np.sqrt(((gap / whole[:, None]) ** 2).sum(1))
    return np.sqrt((gap**2).sum(1))


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` nearest other rows that are found.

    ``score`` is the Euclidean distance of the original vectors in double precision;
    ties go to the smaller vec_id.  Vectors that are null, zero or hold null or
    non-finite components take no part, neither do rows without a vec_id; other columns are ignored.  Vectors of different lengths have no
    distance: a query's candidates are those of its own length.  Fewer candidates give fewer ranks.  Of rows
    that share a vec_id a query finds the nearest; such queries are answered as one.

    Distinct vectors are dealt by hash into shards, at most ``MANY_SHARDS`` until these hold ``MOST_ROWS`` each; a task
    builds the graph of its shard and beam-searches it with every query, batch by batch as queries come.  (To ask
    only the shards of near centres loses neighbours where vectors fill many dimensions.)  Of equal vectors the
    shard carries the k + 1 smallest ids: no query can need more of them.
    """
    good = rows.where(F.col("vec_id").isNotNull() & valid("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("q"))
    found = None
    for length in lengths(good, "embedding"):
        some = _found(good.where(F.size("embedding") == length), k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(good: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` that the shards of ``good(vec_id, embedding, q)``, all of one length, find."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    some = good.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    distinct = saved(some.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "distinct")
    n = distinct.count()
    shards = max(1, min(n // LEAST_ROWS, MANY_SHARDS), -(-n // MOST_ROWS))
    members = distinct.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query_id"), "ids", "embedding")
    queries = good.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("vec_id").alias("query_id"), F.lit(None).cast("array<bigint>").alias("ids"), "embedding")

    def answer(graph: Graph, exact: np.ndarray, ids: list[list[int]], asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = matrix(asked.column("embedding")).astype(float)
        own = asked.column("query_id").to_pylist()
        for a in range(0, len(q), graph.batch):
            found = graph.search(q[a : a + graph.batch], QUERY_BEAM)
            out = []
            for i, row in enumerate(found[:, : 2 * k + 2].tolist()):
                row = [r for r in row if r >= 0]
                score = distances(exact[row], q[a + i]).tolist()
                best = sorted((s, v) for r, s in zip(row, score, strict=True) for v in ids[r] if v != own[a + i])[:k]
                out += [(own[a + i], v, s) for s, v in best]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A shard's members come first, then its queries.
        shard, members, index = None, [], None
        for batch in batches:
            number, is_member = batch.column("shard").to_numpy(), batch.column("query_id").is_null()
            turn = np.flatnonzero(np.diff(number) | np.diff(is_member.to_numpy(zero_copy_only=False).astype(int))) + 1
            edge = [0, *turn.tolist(), len(number)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if x == y:
                    continue
                if number[x] != shard:
                    shard, members, index = number[x], [], None
                if is_member[x].as_py():
                    members.append(batch.slice(x, y - x))
                elif members:
                    if index is None:
                        table = pa.Table.from_batches(members)
                        exact = matrix(table["embedding"].combine_chunks()).astype(float)
                        index = Graph(exact), exact, table["ids"].to_pylist()
                    yield from answer(*index, batch.slice(x, y - x))

    dealt = members.union(queries).repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.col("query_id").isNotNull())
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")
