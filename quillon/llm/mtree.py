"""Exact top-k search by inner product: best-first search of M-trees.

A vector x of whole numbers becomes the point (x, sqrt(M^2 - |x|^2)), M the greatest length, and a query q the point
(q, 0), so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x: the nearest points are the highest products. Each shard of vectors gets
an M-tree in pages: an entry of an inner page has a routing vector, its covering radius and its distance to the page's
own routing vector. A block of queries visits the pages by their least bound d(q, route) - radius; entries whose stored
parent distance already rules them out for every waiting query, by the triangle inequality, are never compared. Bounds
carry a slack for rounding and only strictly worse pages are left out, so scores are exact and ties go to smaller ids.

Each shard's best k for a query meet in one ranking of a query's rows, k from each shard.

Defined cases: a vector that is null or holds null or non-finite components takes no part, nor does one without an id;
shorter vectors count as ending in zeros; a repeated row counts once, and rows of one id are not each other's
candidates; fewer than k candidates are all returned; an empty table gives no rows; vectors so
long that a product of two could leave 64 bits are an error, never a wrapped score; further columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, written

PAGE = 64
SHARD = 8192
BLOCK = 1024  # queries searched together
SUPER = 16384  # queries that meet a shard in one task


def whole(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, components floored to whole numbers of 1/scale."""
    rows = need(vectors, **{id_column: T.LongType(), vector_column: T.ArrayType(T.DoubleType())}).toDF("vec_id", "x")
    good = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(good).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).dropDuplicates(["vec_id", "v"])


class Tree:
    """Pages over points; ``search`` gives each query's best k as (score, id)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, top2: float, pages: list[tuple] | None = None, root: int = -1):
        """Builds the pages, unless they are given."""
        self.ids, self.v = ids, v
        self.exact = v.size == 0 or float(np.abs(v).max()) ** 2 * max(1, v.shape[1]) < 2**52
        x = v.astype(np.float64)
        self.points = np.column_stack([x, np.sqrt(np.maximum(0.0, top2 - (x * x).sum(axis=1)))])
        self.top2 = top2
        self.pages: list[tuple] = pages or []  # (leaf, members or routes, distances to the page's route, radii, children)
        self.compared = self.possible = 0
        self.root = root if pages is not None else self._page(np.arange(len(ids)), 0) if len(ids) else -1

    def _far(self, route: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((self.points[members] - self.points[route]) ** 2).sum(axis=1)))

    def _page(self, members: np.ndarray, route: int) -> int:
        if len(members) <= PAGE:
            self.pages.append((True, members, self._far(route, members), None, None))
            return len(self.pages) - 1
        m = min(PAGE, -(-len(members) // PAGE) * 2)
        routes, near, owner = [], np.full(len(members), np.inf), np.zeros(len(members), int)
        nxt = int(np.argmax(self._far(route, members)))
        for k in range(m):  # the next routing vector is the one farthest from those there are
            d = self._far(members[nxt], members)
            owner = np.where(d < near, k, owner)
            near = np.minimum(near, d)
            routes.append(members[nxt])
            nxt = int(np.argmax(near))
            if near[nxt] == 0:
                break
        groups = [members[owner == k] for k in range(len(routes))]
        if max(map(len, groups)) == len(members):  # equal points: cut evenly
            groups = np.array_split(members, m)
            routes = [routes[0]] * len(groups)
        routes, groups = zip(*[(r, g) for r, g in zip(routes, groups, strict=True) if len(g)], strict=True)
        radii = np.array([self._far(r, g).max() for r, g in zip(routes, groups, strict=True)])
        children = [self._page(g, r) for r, g in zip(routes, groups, strict=True)]
        routes = np.array(routes)
        self.pages.append((False, routes, self._far(route, routes), radii, children))
        return len(self.pages) - 1

    def _scores(self, q: np.ndarray, members: np.ndarray) -> np.ndarray:
        if self.exact and (q.size == 0 or float(np.abs(q).max()) * max(1.0, float(np.abs(self.v).max(initial=0))) * max(1, q.shape[1]) < 2**52):
            return np.rint(q.astype(np.float64) @ self.v[members].T.astype(np.float64)).astype(np.int64)
        return q @ self.v[members].T

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        best: list[list[tuple[int, int]]] = [[] for _ in q_ids]  # (-score, id), ascending
        if self.root < 0 or not len(q_ids):
            return best
        q2 = (q.astype(np.float64) ** 2).sum(axis=1)
        slack = 1e-9 * (q2 + self.top2) + 1e-6
        kth = np.full(len(q_ids), np.inf)  # a distance beyond which nothing is wanted
        dist = lambda s, rows: np.sqrt(np.maximum(0.0, q2[rows, None] + self.top2 - 2.0 * s))
        n = len(q_ids)
        heap = [(0.0, 0, self.root, np.zeros(n), dist(self._scores(q, np.array([0])), np.arange(n))[:, 0])]  # the root's route is the first vector
        order = 0
        while heap:
            _, _, at, least, to_route = heapq.heappop(heap)
            rows = np.flatnonzero(least <= kth)
            if not len(rows):
                continue
            leaf, members, far, radii, children = self.pages[at]
            reach = 0.0 if leaf else radii[None, :]
            open_ = np.abs(to_route[rows, None] - far[None, :]) - reach <= kth[rows, None] + 1e-6 * (1 + to_route[rows, None])
            cols = np.flatnonzero(open_.any(axis=0))
            self.possible += len(rows) * len(members)
            self.compared += len(rows) * len(cols)
            if not len(cols):
                continue
            scores = self._scores(q[rows], members[cols])
            if leaf:
                hit = self.ids[members[cols]]
                enough = np.array([-best[r][-1][0] if len(best[r]) == k else -(1 << 62) for r in rows])
                for i in np.flatnonzero((scores >= enough[:, None]).any(axis=1)):
                    r = rows[i]
                    s = scores[i]
                    own = [(-int(s[j]), int(hit[j])) for j in np.flatnonzero(s >= enough[i]) if hit[j] != q_ids[r]]
                    best[r] = heapq.nsmallest(k, set(best[r] + own))
                    if len(best[r]) == k:
                        kth[r] = np.sqrt(max(0.0, q2[r] + self.top2 + 2.0 * best[r][-1][0] + slack[r]))
                continue
            d = dist(scores, rows)
            for j, c in enumerate(cols):
                bound = np.full(n, np.inf)
                bound[rows] = np.maximum(0.0, d[:, j] - radii[c]) * (1 - 1e-9) - 1e-6
                going = bound <= kth
                if going.any():
                    route = np.zeros(n)
                    route[rows] = d[:, j]
                    order += 1
                    heapq.heappush(heap, (float(bound[going].min()), order, children[c], bound, route))
        return best


_PAGES = T.StructType([T.StructField("shard", T.LongType()), T.StructField("page", T.LongType()), T.StructField("node", T.BinaryType())])
_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _plant(dim: int, top2: float):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        tree = Tree(np.array(t["vec_id"].to_pylist(), np.int64), _matrix(t["v"], dim), top2)
        shard = t["shard"][0].as_py()
        nodes = [pickle.dumps((tree.ids, tree.v, tree.root, len(tree.pages))), *(pickle.dumps(p) for p in tree.pages)]
        return pa.table({"shard": pa.array([shard] * len(nodes), pa.int64()), "page": pa.array(range(len(nodes)), pa.int64()), "node": pa.array(nodes, pa.binary())})

    return run


def _look(dim: int, top2: float, k: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not pages.num_rows or not queries.num_rows:
            return empty
        nodes = [pickle.loads(x) for x in pages.sort_by("page")["node"].to_pylist()]
        ids, v, root, n = nodes[0]
        tree = Tree(ids, v, top2, nodes[1 : n + 1], root)
        q_ids, q = np.array(queries["vec_id"].to_pylist(), np.int64), _matrix(queries["v"], dim)
        out: list[tuple[int, int, int]] = []
        for a in range(0, len(q_ids), BLOCK):
            found = tree.search(q_ids[a : a + BLOCK], q[a : a + BLOCK], k)
            out += [(int(i), d, -s) for i, b in zip(q_ids[a : a + BLOCK], found, strict=True) for s, d in b]
        if not out:
            return empty
        cols = list(zip(*out, strict=True))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(_FOUND.names, cols, strict=True)})

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the best k of every vector for each query, a vector whose id is divisible by ``every``."""
    rows = written(whole(vectors, id_column, vector_column, scale), "mtree-vectors")
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    is_query = F.col("vec_id") % every == 0
    n, q, dim, top2 = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v")), F.max(length2)).first()
    dim, top2 = dim or 0, float(top2 or 0.0)
    if top2 >= 2.0**63:
        raise ValueError(f"scores of vectors of squared length {top2:.3g} don't fit 64 bits")
    shards, supers = max(1, -(-n // SHARD)), max(1, -(-q // SUPER))
    planted = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("long")).groupBy("shard").applyInArrow(_plant(dim, top2), _PAGES)
    pages = written(planted, "mtree-pages").withColumn("super", F.explode(F.sequence(F.lit(0), F.lit(supers - 1))))
    asked = rows.where(is_query).withColumn("super", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(supers)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    found = pages.groupBy("shard", "super").cogroup(asked.groupBy("shard", "super")).applyInArrow(_look(dim, top2, k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
