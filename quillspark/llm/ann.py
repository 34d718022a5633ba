"""Approximate nearest neighbours: a navigable small-world graph for each shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their key. In each shard distinct
vectors are put into a hierarchical navigable small-world graph, kept as flat arrays: one row of
neighbour numbers for each vector and level, padded with -1. Equal vectors share one node, whose
``k`` + 1 smallest keys suffice for any answer, ties going to smaller keys. Inner products are turned
into distances by one more coordinate (the root of the largest squared norm less the vector's own),
so that nearness does not depend on norms.

Building and searching advance many vectors at once: each step takes the best open candidate of every
query in a block, gathers the neighbours of all and merges them into the queries' lists in numpy.

A task builds the index of one shard and then takes all queries, block by block; the shards' answers
are merged by (score, key), of which each shard sends ``k`` for each query at most. Scores are exact
double-precision inner products.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; rows with the same key count as one (the first in order of vector); a query
is never its own answer; with fewer candidates than ``k`` all are returned; an empty table gives none;
columns beside key and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


class Graph:
    """A hierarchical navigable small-world graph over rows of ``points`` with squared Euclidean distance."""

    def __init__(self, points: np.ndarray, links: int = 16, breadth: int = 96, seed: int = 11):
        n, self.points = len(points), np.ascontiguousarray(points, dtype=np.float32)
        self.norms = (self.points**2).sum(1)
        self.links, self.breadth = links, breadth
        rng = np.random.Generator(np.random.PCG64(seed))
        top = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(links)).astype(np.int64), 8)
        order = np.argsort(-top, kind="stable")  # the upper levels are complete before the lower ones fill
        self.entry = int(order[0]) if n else -1
        self.levels = [np.full((n, 2 * links if level == 0 else links), -1, np.int32) for level in range(int(top.max(initial=0)) + 1)]
        done = 0
        while done < n:
            # early blocks are small, so that their members find each other
            size = 1 if done == 0 else min(_BLOCK, max(1, done // 2))
            block = order[done : done + size]
            if done:
                self._insert(block, top[block])
            done += len(block)

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances (less the queries' own norm) of each query to its row of ids."""
        return self.norms[ids] - 2 * np.einsum("bd,bkd->bk", q, self.points[ids])

    def _descend(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """Greedy search from the entry to the nearest node on level ``down_to`` + 1."""
        at = np.full(len(q), self.entry)
        best = self._distance(q, at[:, None])[:, 0]
        for level in range(len(self.levels) - 1, down_to, -1):
            live = np.arange(len(q))
            while len(live):
                near = self.levels[level][at[live]]
                d = np.where(near >= 0, self._distance(q[live], np.maximum(near, 0)), np.inf)
                pick = d.argmin(1)
                better = d[np.arange(len(live)), pick] < best[live]
                live, pick, d, near = live[better], pick[better], d[better], near[better]
                at[live], best[live] = near[np.arange(len(live)), pick], d[np.arange(len(live)), pick]
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``breadth`` nearest nodes found from ``start``: ids (-1: none) and distances, nearest first."""
        b = len(q)
        ids = np.full((b, breadth), -1, np.int64)
        dist = np.full((b, breadth), np.inf, np.float32)
        opened = np.ones((b, breadth), bool)
        ids[:, 0], dist[:, 0], opened[:, 0] = start, self._distance(q, start[:, None])[:, 0], False
        seen = np.zeros((b, len(self.points)), bool)
        seen[np.arange(b), start] = True
        live = np.arange(b)
        near_of = self.levels[level]
        while len(live):
            waiting = np.where(opened[live], np.inf, dist[live])
            pick = waiting.argmin(1)
            go = waiting[np.arange(len(live)), pick] < np.inf
            live, pick = live[go], pick[go]
            if not len(live):
                break
            opened[live, pick] = True
            near = near_of[ids[live, pick]].astype(np.int64)
            safe = np.maximum(near, 0)
            new = (near >= 0) & ~seen[live[:, None], safe]
            at, which = np.nonzero(near >= 0)
            seen[live[at], near[at, which]] = True
            d = np.where(new, self._distance(q[live], safe), np.inf)
            every_d = np.concatenate([dist[live], d], 1)
            every_i = np.concatenate([ids[live], near], 1)
            every_o = np.concatenate([opened[live], ~new], 1)
            keep = np.argpartition(every_d, breadth - 1, axis=1)[:, :breadth]
            rows = np.arange(len(live))[:, None]
            dist[live], ids[live], opened[live] = every_d[rows, keep], every_i[rows, keep], every_o[rows, keep]
        order = np.argsort(dist, 1, kind="stable")
        rows = np.arange(b)[:, None]
        ids, dist = ids[rows, order], dist[rows, order]
        return np.where(np.isinf(dist), -1, ids), dist

    def _spread(self, q: np.ndarray, ids: np.ndarray, dist: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions: a candidate nearer to one already chosen than to the query waits for a second turn."""
        b, k = ids.shape
        chosen = np.full((b, most), -1, np.int64)
        filled = np.zeros(b, np.int64)
        passed = np.zeros((b, k), bool)
        for j in range(k):
            fits = (ids[:, j] >= 0) & (filled < most)
            rows = np.flatnonzero(fits)
            if not len(rows):
                continue
            c = ids[rows, j]
            others = chosen[rows]
            between = self._distance(self.points[c], np.maximum(others, 0)) + self.norms[c][:, None]
            between = np.where(others >= 0, between, np.inf)
            good = (between >= (dist[rows, j] + own[rows])[:, None]).all(1)
            passed[rows[~good], j] = True
            rows = rows[good]
            chosen[rows, filled[rows]] = ids[rows, j]
            filled[rows] += 1
        for j in range(k):
            rows = np.flatnonzero(passed[:, j] & (filled < most))
            chosen[rows, filled[rows]] = ids[rows, j]
            filled[rows] += 1
        return chosen

    def _insert(self, block: np.ndarray, top: np.ndarray) -> None:
        q, own = self.points[block], self.norms[block]
        for level in range(len(self.levels) - 1, -1, -1):
            at = np.flatnonzero(top >= level)
            if not len(at):
                continue
            start = self._descend(q[at], level)
            ids, dist = self._beam(q[at], start, level, self.breadth)
            # members of the block also know each other
            inner = self.norms[block[at]][None, :] - 2 * q[at] @ q[at].T
            np.fill_diagonal(inner, np.inf)
            peers = np.argsort(inner, 1)[:, : min(self.links, len(at) - 1)] if len(at) > 1 else np.zeros((len(at), 0), np.int64)
            # the descent may have come by a member of the block: no edge to oneself, none twice
            near, apart = block[at][peers], np.take_along_axis(inner, peers, 1).astype(np.float32)
            apart[(near[:, :, None] == ids[:, None, :]).any(2)] = np.inf
            dist[ids == block[at][:, None]] = np.inf
            ids, dist = np.concatenate([ids, near], 1), np.concatenate([dist, apart], 1)
            ids[np.isinf(dist)] = -1
            order = np.argsort(dist, 1, kind="stable")[:, : self.breadth]
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            table = self.levels[level]
            near = self._spread(q[at], ids, dist, own[at], self.links)
            table[block[at], : self.links] = near
            self._link_back(table, block[at], near)

    def _link_back(self, table: np.ndarray, block: np.ndarray, near: np.ndarray) -> None:
        """Edges from the neighbours; a neighbour whose row is full keeps a spread of the nearest."""
        source, target = np.repeat(block, near.shape[1]), near.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, many = np.unique(target, return_index=True, return_counts=True)
        width = table.shape[1]
        most = int(many.max(initial=0))
        more = np.full((len(nodes), most), -1, np.int64)
        more[np.repeat(np.arange(len(nodes)), many), np.arange(len(target)) - np.repeat(first, many)] = source
        every = np.concatenate([table[nodes].astype(np.int64), more], 1)
        every.sort(1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1  # an edge may be there already
        counts = (every >= 0).sum(1)
        every = -np.sort(-every, 1)
        roomy = counts <= width
        table[nodes[roomy]] = _fit(every[roomy], width)
        full = ~roomy
        if full.any():
            ids = every[full]
            q = self.points[nodes[full]]
            dist = np.where(ids >= 0, self._distance(q, np.maximum(ids, 0)), np.inf)
            order = np.argsort(dist, 1, kind="stable")
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            table[nodes[full]] = self._spread(q, ids, dist.astype(np.float32), self.norms[nodes[full]], width)

    def search(self, queries: np.ndarray, k: int, breadth: int) -> np.ndarray:
        """Nodes nearest to each query (-1: none), nearest first."""
        q = np.ascontiguousarray(queries, dtype=np.float32)
        out = []
        for begin in range(0, len(q), _BLOCK):
            part = q[begin : begin + _BLOCK]
            ids, _ = self._beam(part, self._descend(part, 0), 0, max(k, breadth))
            out.append(ids[:, :k])
        return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def _fit(ids: np.ndarray, width: int) -> np.ndarray:
    out = np.full((len(ids), width), -1, np.int32)
    n = min(width, ids.shape[1])
    out[:, :n] = ids[:, :n]
    return out


class Shard:
    """The vectors of one shard with their graph. Equal vectors share a node."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int, **graph):
        order = np.argsort(keys, kind="stable")
        keys, vectors = keys[order], vectors[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.keys, self.vectors = keys[first], vectors[first]
        _, node, inverse = np.unique(self.vectors, axis=0, return_index=True, return_inverse=True)
        by_node = np.argsort(inverse.ravel(), kind="stable")  # keys ascend within a node
        sorted_nodes = inverse.ravel()[by_node]
        rank = np.arange(len(by_node)) - np.searchsorted(sorted_nodes, sorted_nodes)
        held = rank <= k
        self.members = by_node[held]
        self.first = np.searchsorted(sorted_nodes[held], np.arange(len(node) + 1))
        distinct = self.vectors[node]
        squares = (distinct.astype(np.float64) ** 2).sum(1)
        last = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
        self.graph = Graph(np.concatenate([distinct, last[:, None]], 1), **graph)

    def search(self, keys: np.ndarray, queries: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, key and exact score of at most ``k`` answers for each query."""
        nodes = self.graph.search(np.concatenate([queries, np.zeros((len(queries), 1))], 1), k + 1, breadth)
        number, place = np.nonzero(nodes >= 0)
        node = nodes[number, place]
        many = self.first[node + 1] - self.first[node]
        number = np.repeat(number, many)
        member = self.members[np.repeat(self.first[node], many) + np.arange(len(number)) - np.repeat(np.cumsum(many) - many, many)]
        other = self.keys[member] != keys[number]
        number, member = number[other], member[other]
        score = np.einsum("nd,nd->n", queries[number].astype(np.float64), self.vectors[member].astype(np.float64))
        order = np.lexsort((self.keys[member], -score, number))
        number, member, score = number[order], member[order], score[order]
        rank = np.arange(len(number)) - np.searchsorted(number, number)
        best = rank < k
        return number[best], self.keys[member[best]], score[best]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows that take part: v is array<double>."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("v")).where("key is not null and v is not null and size(v) > 0")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.coalesce(sound, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, shard_rows: int = 16384, links: int = 16, build_breadth: int = 96, breadth: int = 128) -> DataFrame:
    """The ``k`` rows of ``df`` of the largest inner product with each row of ``queries``: query_id, rank, vec_id, score.

    Each shard's graph is built in the task that then takes the queries block by block; the shard's
    vectors (``shard_rows`` on average, a bounded number) are all that it holds.
    """
    rows, asked = usable(df, key, vector), usable(queries, key, vector)
    widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not widths:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = widths[0][0]
    rows, asked = rows.where(F.size("v") == width), asked.where(F.size("v") == width).groupBy("key").agg(F.min("v").alias("v"))
    shards = max(1, -(-rows.count() // shard_rows))
    stored = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "key", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "key", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, vectors, shard = None, [], [], None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if numbers[a] != current:
                    current, keys, vectors, shard = numbers[a], [], [], None
                own, matrix = batch.column(2).slice(a, b - a).to_numpy(), _matrix(batch.column(3).slice(a, b - a))
                if kinds[a] == 0:
                    keys.append(own)
                    vectors.append(matrix)
                    continue
                if shard is None:
                    if not keys:
                        continue
                    shard = Shard(np.concatenate(keys), np.concatenate(vectors), k, links=links, breadth=build_breadth)
                    keys, vectors = [], []
                for begin in range(0, len(own), 2048):
                    q = own[begin : begin + 2048]
                    number, found, score = shard.search(q, matrix[begin : begin + 2048], k, breadth)
                    yield pa.RecordBatch.from_arrays([pa.array(q[number]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    # a shard's number is its task's: no two shards meet in one
    dealt = stored.unionByName(sent).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "key", "v").select("shard", "kind", "key", "v")
    found = dealt.mapInArrow(run, schema)
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
