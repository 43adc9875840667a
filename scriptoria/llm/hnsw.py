"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

`build` deals the vectors out to shards by a hash and stores each shard's graph as one row of flat
arrays: the distinct vectors, the ids behind each of them, and for every level the neighbour lists
with their degrees. `search` takes query blocks to every shard, walks its graph, measures the
candidates found exactly in double precision, and merges the shards' best.

Equal vectors are one node, so large groups of copies do not close the graph off. Insertion keeps the
diverse neighbours only; a list may grow to twice its size before it is cut back.

Graphs are walked in single precision, scaled where a shard's components are very large or small; distances
are of the vectors as they came, in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id; rows equal in id and vector count once; an id with several vectors is so many rows, and as many
queries, each of which has the others among its candidates; vectors are compared with those of their own length
only; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import cut

LINKS, EF_BUILD, EF_SEARCH = 16, 64, 96
#: A shard holds between these numbers of vectors, with about SHARDS shards in between.
LEAST, MOST, SHARDS = 8192, 131072, 64
#: Queries that one visit of a shard answers; the index is sent once for so many.
QUERY_BLOCK = 65536
#: Vectors for which `ef` is meant; more need a longer list of candidates.
EF_FOR = 2048


class Graph:
    """The graph of one shard over float32 vectors."""

    def __init__(self, x: np.ndarray, links: int = LINKS):
        n = len(x)
        self.x, self.m = np.ascontiguousarray(x, np.float32), links
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.level = np.minimum((-np.log(1 - np.random.default_rng(5).random(n)) / np.log(links)).astype(np.int64), 12)
        self.links: list[np.ndarray] = []
        self.degree: list[np.ndarray] = []
        self.entry, self.top = -1, -1
        self.seen, self.mark = np.zeros(n, np.int64), 0

    def _room(self, level: int) -> int:
        return self.m * (4 if level == 0 else 2)

    def walk(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The `ef` nearest found from the starts on a level, nearest first (distances short of |q|²)."""
        self.mark += 1
        mark, seen, links, degree, x, norm = self.mark, self.seen, self.links[level], self.degree[level], self.x, self.norm
        for _, s in starts:
            seen[s] = mark
        open_, best = list(starts), [(-d, s) for d, s in starts]
        heapq.heapify(open_)
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        q2 = -2.0 * q
        while open_:
            d, c = heapq.heappop(open_)
            full = len(best) >= ef
            if full and d > -best[0][0]:
                break
            near = links[c, : degree[c]]
            near = near[seen[near] != mark]
            if not near.size:
                continue
            seen[near] = mark
            ds = norm[near] + x[near] @ q2
            if full:
                keep = ds < -best[0][0]
                near, ds = near[keep], ds[keep]
            for d, c in zip(ds.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-d, c))
                    heapq.heappush(open_, (d, c))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, c))
                    heapq.heappush(open_, (d, c))
        return sorted((-d, c) for d, c in best)

    def diverse(self, of: int, near: np.ndarray, keep: int) -> np.ndarray:
        """Those of `near` (nearest first) that are closer to `of` than to any taken before; then the rest up to `keep`."""
        if len(near) <= 1:
            return near
        x = self.x[near]
        to = self.norm[near] + self.norm[of] - 2 * (x @ self.x[of])
        between = self.norm[near][:, None] + self.norm[near][None, :] - 2 * (x @ x.T)
        closest = np.full(len(near), np.inf)
        taken, left = [], []
        for k in range(len(near)):
            if len(taken) >= keep:
                break
            if to[k] < closest[k]:
                taken.append(k)
                np.minimum(closest, between[k], out=closest)
            else:
                left.append(k)
        taken += left[: keep - len(taken)]
        return near[taken]

    def build(self, ef: int = EF_BUILD) -> Graph:
        n = len(self.x)
        for level in range(int(self.level.max(initial=-1)) + 1):
            self.links.append(np.zeros((n, self._room(level)), np.int32))
            self.degree.append(np.zeros(n, np.int32))
        for i in range(n):
            self._insert(i, ef)
        for level, links in enumerate(self.links):  # lists back to their nominal size
            most = self._room(level) // 2
            for i in np.flatnonzero(self.degree[level] > most).tolist():
                self._cut(level, i, most)
            self.links[level] = np.ascontiguousarray(links[:, :most])
        return self

    def _cut(self, level: int, i: int, keep: int) -> None:
        near = self.links[level][i, : self.degree[level][i]]
        order = np.argsort(self.norm[near] - 2 * (self.x[near] @ self.x[i]), kind="stable")
        near = self.diverse(i, near[order], keep)
        self.links[level][i, : len(near)] = near
        self.degree[level][i] = len(near)

    def _descend(self, q: np.ndarray, upto: int) -> list[tuple[float, int]]:
        at = [(float(self.norm[self.entry] - 2.0 * (self.x[self.entry] @ q)), self.entry)]
        for level in range(self.top, upto, -1):
            at = self.walk(q, at, 1, level)[:1]
        return at

    def _insert(self, i: int, ef: int) -> None:
        mine = int(self.level[i])
        if self.entry < 0:
            self.entry, self.top = i, mine
            return
        q = self.x[i]
        at = self._descend(q, mine)
        for level in range(min(mine, self.top), -1, -1):
            at = self.walk(q, at, ef, level)
            near = self.diverse(i, np.array([c for _, c in at], np.int32), self.m)
            links, degree = self.links[level], self.degree[level]
            links[i, : len(near)] = near
            degree[i] = len(near)
            room = self._room(level)
            for c in near.tolist():
                if degree[c] == room:
                    self._cut(level, c, room // 2)
                links[c, degree[c]] = i
                degree[c] += 1
        if mine > self.top:
            self.entry, self.top = i, mine

    def find(self, q: np.ndarray, ef: int = EF_SEARCH) -> list[int]:
        """Nodes near q, nearest first by single-precision distance. `ef` is for EF_FOR nodes and grows as the root of more."""
        if self.entry < 0:
            return []
        ef = max(ef, int(ef * (len(self.x) / EF_FOR) ** 0.5))
        q = q.astype(np.float32)
        return [c for _, c in self.walk(q, self._descend(q, 0), ef, 0)]

    def arrays(self) -> dict:
        return {
            "entry": self.entry, "top": self.top, "links": [a.astype("<i4").tobytes() for a in self.links], "degree": [a.astype("<i4").tobytes() for a in self.degree],
        }

    @classmethod
    def load(cls, row: dict, x: np.ndarray, links: int = LINKS) -> Graph:
        g = cls.__new__(cls)
        g.x, g.m = np.ascontiguousarray(x, np.float32), links
        n = len(g.x)
        g.norm = np.einsum("ij,ij->i", g.x, g.x)
        g.links = [np.frombuffer(b, "<i4").reshape(n, -1) for b in row["links"]]
        g.degree = [np.frombuffer(b, "<i4") for b in row["degree"]]
        g.entry, g.top, g.seen, g.mark = row["entry"], row["top"], np.zeros(n, np.int64), 0
        return g


INDEX = pa.schema([
    ("shard", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("scale", pa.float64()), ("entry", pa.int32()), ("top", pa.int32()), ("vectors", pa.binary()), ("links", pa.list_(pa.binary())), ("degree", pa.list_(pa.binary())),
    ("ids", pa.binary()), ("starts", pa.binary()),
])
INDEX_DDL = "shard int,dim int,kind string,scale double,entry int,top int,vectors binary,links array<binary>,degree array<binary>,ids binary,starts binary"


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part, each pair of id and vector once; components are floats, or doubles where they came as anything else."""
    kind = "array<float>" if df.schema[vector].dataType.elementType.simpleString() == "float" else "array<double>"
    plus = F.transform(F.col(vector).cast(kind), lambda x: x + F.lit(0).cast(kind[6:-1]))  # -0 and 0 are equal
    return df.where(valid(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), plus.alias("v")).dropDuplicates(["id", "v"])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scale(x: np.ndarray) -> float:
    """What brings the largest component near one, if single precision could not square them."""
    most = float(np.abs(x).max(initial=0.0))
    return 1.0 if most == 0 or 1e-12 < most < 1e12 else 1.0 / most if most > 1e-300 else 1e300


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
    far = np.abs(x - q).max(axis=1)
    lost = ~np.isfinite(d) | ((d == 0) & (far > 0))  # squares beyond what doubles hold
    if lost.any():
        d[lost] = far[lost] * np.sqrt((((x[lost] - q) / far[lost, None]) ** 2).sum(axis=1))
    return d


def shard_count(rows: int) -> int:
    return max(1, -(-rows // min(MOST, max(LEAST, rows // SHARDS))))


def build(vectors: DataFrame, shards: int, ef: int = EF_BUILD) -> DataFrame:
    """INDEX rows of the vectors of `usable`, one for each shard and vector length."""

    def each(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x, ids = _matrix(t.column("v"), dim), t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        _, first, node = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
        rank = np.argsort(np.argsort(first))  # nodes in the order of their smallest id
        node = rank[node.ravel()]
        by_node = np.argsort(node, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=len(first)))))
        x = np.ascontiguousarray(x[np.sort(first)])
        scale = _scale(x)
        graph = Graph(x * x.dtype.type(scale) if scale != 1.0 else x).build(ef)
        row = {"shard": t.column("shard")[0].as_py(), "dim": dim, "kind": x.dtype.str, "scale": scale, "vectors": x.tobytes(), "ids": ids[by_node].astype("<i8").tobytes(), "starts": starts.astype("<i8").tobytes()} | graph.arrays()
        return pa.Table.from_pylist([row], schema=INDEX)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))
    return dealt.groupBy("shard", "dim").applyInArrow(each, INDEX_DDL)


def search(index: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (id, v), its own row left out."""

    out = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            dim = row["dim"]
            kept, scale = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dim), row["scale"]
            graph = Graph.load(row, kept * kept.dtype.type(scale) if scale != 1.0 else kept)
            ids, starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
            x, names, numbers = _matrix(right.column("v"), dim), right.column("id").to_pylist(), right.column("query").to_pylist()
            for q, name, number in zip(x, names, numbers, strict=True):
                nodes = np.array(graph.find(q * scale, ef), np.int64)
                if not nodes.size:
                    continue
                d = _distances(kept[nodes].astype(np.float64), q.astype(np.float64))
                nodes = nodes[np.argsort(d, kind="stable")]
                d = np.sort(d)
                best: list[tuple[float, int]] = []
                for dist, n in zip(d.tolist(), nodes.tolist(), strict=True):
                    if len(best) >= k and dist > best[k - 1][0]:
                        break
                    # ids of a node ascend: the first k and one more, for the query's own, are enough
                    best += [(dist, i) for i in ids[starts[n] : min(starts[n + 1], starts[n] + k + 1)].tolist() if i != name or dist]
                    best.sort()
                found += [(name, number, i, dist) for dist, i in best[:k]]
        return pa.table([pa.array([f[c] for f in found], out.field(c).type) for c in range(4)], schema=out)

    dealt = queries.withColumn("query", F.xxhash64("v")).withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("block", F.lit(0))
    near = spread.groupBy("shard", "dim", "block").cogroup(dealt.groupBy("shard", "dim", "block")).applyInArrow(each, "query_id long,query long,vec_id long,score double")
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """Index all usable rows and search those that satisfy `is_query` (an expression over `id`)."""
    vectors = cut(usable(df, key, vector))
    rows, asked = vectors.count(), vectors.where(is_query).count()
    shards = shard_count(rows)
    index = cut(build(vectors, shards))
    return search(index, vectors.where(is_query), shards, max(1, -(-asked // QUERY_BLOCK)), k, ef)
