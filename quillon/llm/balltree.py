"""Hard-negative mining by ball trees: branch and bound on inner products from above and below.

Rows of one label are dealt to cells around pivots, a cell to shards of bounded size, and each shard gets a ball tree: a
node has a centre c and a radius r, so that for a query q every row x below it has q.c - |q| r <= q.x <= q.c + |q| r.
A search leaves out a node whose interval misses the window of scores that is asked for, or whose upper bound is
strictly beneath the k-th best there is. Requests go out in two waves: the first to the one shard whose centre promises
most, which gives each request a k-th best; the second only to those shards whose root passes the same two tests.
Bounds carry a slack for rounding and scores are whole numbers, so results are exact, ties going to smaller ids.

``mine`` runs this twice: for each anchor's positives (its label's shards, no window), then for each positive's
negatives (the shards of all other labels, the window between two shares of the positive's score).

Bounds: pivots are at most ``PIVOTS`` rows of the ``SAMPLE`` rows of least hash (they change cost, not results); a task
holds one shard's tree (``SHARD`` rows) and ``BLOCK`` requests. Summaries of shards (a centre each) meet requests in
blocks of ``SUMMARIES``, nothing is broadcast. A cell with very many rows, equal ones too, is several shards.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part; shorter
vectors count as ending in zeros; repeated rows are rows of their own, so a copy of an anchor may be its positive; an
anchor without positives, or a positive without negatives in its window, gives no rows; an empty table gives no rows;
vectors so long that a product of two could leave 64 bits are an error; further columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, need, written

LEAF = 64
SHARD = 4096
PIVOTS = 256
SAMPLE = 4096
BLOCK = 16384
SUMMARIES = 2048
#: Scores are within 62 bits; these stand for no lower bound, no upper bound and no id.
LOW, HIGH, NONE = -(1 << 62), 1 << 62, (1 << 63) - 1


def matrix(column: pa.ChunkedArray, dim: int, kind: type = np.int64) -> np.ndarray:
    """Lists of numbers as rows of a matrix, shorter ones ending in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), kind)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


class Tree:
    """A ball tree over rows of whole numbers; ``search`` improves each request's best k."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rid, self.ids, self.v = rid[order], ids[order], v[order]
        self.x = self.v.astype(np.float64)
        self.nodes: list[tuple] = []  # (centre, radius, start, end, left, right): left is -1 for a leaf
        self.most = float(np.abs(self.x).max(initial=0.0))
        self.looked = self.possible = 0
        if len(ids):
            self._grow(0, len(ids))

    def __getstate__(self) -> tuple:
        return self.rid, self.ids, self.v, self.nodes, self.most

    def __setstate__(self, state: tuple) -> None:
        self.rid, self.ids, self.v, self.nodes, self.most = state
        self.x, self.looked, self.possible = self.v.astype(np.float64), 0, 0

    def _grow(self, a: int, e: int) -> int:
        x = self.x[a:e]
        centre = x.mean(axis=0)
        far = ((x - centre) ** 2).sum(axis=1)
        me = len(self.nodes)
        self.nodes.append((centre, float(np.sqrt(far.max())), a, e, -1, -1))
        if e - a > LEAF:
            one = x[int(far.argmax())]
            other = x[int(((x - one) ** 2).sum(axis=1).argmax())]
            along = x @ (other - one)
            order = np.argsort(along, kind="stable")  # equal rows stay in the order of their ids
            half = int(np.searchsorted(along[order], (other - one) @ (other + one) / 2))  # nearer to the one, nearer to the other
            half = half if 8 * min(half, e - a - half) >= e - a else (e - a) // 2
            order = order + a
            for part in (order[:half], order[half:]):
                part.sort()  # rows lie by id, so a leaf's do
            order = np.concatenate([order[:half], order[half:]])
            self.rid[a:e], self.ids[a:e], self.v[a:e], self.x[a:e] = self.rid[order], self.ids[order], self.v[order], self.x[order]
            left, right = self._grow(a, a + half), self._grow(a + half, e)
            self.nodes[me] = (*self.nodes[me][:4], left, right)
        return me

    def _scores(self, q: np.ndarray, a: int, e: int) -> np.ndarray:
        if self.most * float(np.abs(q).max(initial=0)) * max(1, q.shape[1]) < 2**52:
            return np.rint(q.astype(np.float64) @ self.x[a:e].T).astype(np.int64)
        return q @ self.v[a:e].T

    def search(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        """best, who: (requests, k) scores, descending, and ids; LOW and NONE where there is none yet. own: the row that a request doesn't want."""
        if not len(self.ids) or not len(q):
            return
        x = q.astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1))

        def bounds(node: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            centre, radius = self.nodes[node][:2]
            middle, reach = x[rows] @ centre, size[rows] * radius
            slack = 1e-9 * (np.abs(middle) + reach + size[rows] * np.sqrt(centre @ centre)) + 1e-6
            return middle - reach - slack, middle + reach + slack

        def wanted(rows: np.ndarray, under: np.ndarray, above: np.ndarray) -> np.ndarray:
            return (under <= hi[rows]) & (above >= lo[rows]) & (above >= best[rows, -1])

        rows = np.arange(len(q))
        under, above = bounds(0, rows)
        heap = [(-float(above.max()), 0, rows, under, above)]
        while heap:
            _, node, rows, under, above = heapq.heappop(heap)
            keep = wanted(rows, under, above)
            rows = rows[keep]
            _, _, a, e, left, right = self.nodes[node]
            if not len(rows):
                continue
            if left < 0:
                self.looked += len(rows) * (e - a)
                s = self._scores(q[rows], a, e)
                s[(s < lo[rows, None]) | (s > hi[rows, None]) | (self.rid[None, a:e] == own[rows, None])] = LOW
                better = np.flatnonzero(((s >= best[rows, -1:]) & (s > LOW)).any(axis=1))
                if len(better):
                    r, s = rows[better], s[better]
                    ids = np.where(s > LOW, self.ids[None, a:e], NONE)
                    s, ids = np.concatenate([best[r], s], axis=1), np.concatenate([who[r], ids], axis=1)
                    order = np.lexsort((ids, -s), axis=1)[:, : best.shape[1]]
                    best[r], who[r] = np.take_along_axis(s, order, axis=1), np.take_along_axis(ids, order, axis=1)
                continue
            for child in (left, right):
                under, above = bounds(child, rows)
                open_ = wanted(rows, under, above)
                if open_.any():
                    heapq.heappush(heap, (-float(above[open_].max()), child, rows[open_], under[open_], above[open_]))
        self.possible += len(q) * len(self.ids)


def _nearest(pivots: np.ndarray):
    """Adds the cell of each row: its nearest pivot."""
    square = (pivots**2).sum(axis=1)

    def run(batches):
        for b in batches:
            x = matrix(b["v"], pivots.shape[1], np.float64)
            yield b.append_column("cell", pa.array(np.argmin(square - 2.0 * (x @ pivots.T), axis=1).astype(np.int32), pa.int32()))

    return run


def _plant(dim: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rid")
        tree = Tree(np.array(t["rid"]), np.array(t["vec_id"]), matrix(t["v"], dim).copy())
        centre, radius = tree.nodes[0][:2]
        one = {c: t[c][:1] for c in ("label", "shard")}
        return pa.table(one | {"centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _route(dim: int, same: bool, first: bool):
    """For requests and a block of shards' summaries: the most promising shard, or else those that may hold wanted rows."""
    names = ("request", "shard", "promise")
    empty = pa.table({"request": pa.array([], pa.int64()), "shard": pa.array([], pa.string()), "promise": pa.array([], pa.float64())})

    def run(requests: pa.Table, shards: pa.Table) -> pa.Table:
        if not requests.num_rows or not shards.num_rows:
            return empty
        shards = shards.sort_by("shard")
        centres, radii = matrix(shards["centre"], dim, np.float64), np.array(shards["radius"])
        labels, names_ = np.array(shards["label"]), np.array(shards["shard"].to_pylist(), object)
        length = np.sqrt((centres**2).sum(axis=1))
        out: list[pa.Table] = []
        for a in range(0, requests.num_rows, 2048):
            t = requests.slice(a, 2048)
            x, lo, hi, kth = matrix(t["q"], dim, np.float64), np.array(t["lo"]), np.array(t["hi"]), np.array(t["kth"])
            size = np.sqrt((x * x).sum(axis=1))[:, None]
            middle, reach = x @ centres.T, size * radii
            slack = 1e-9 * (np.abs(middle) + reach + size * length) + 1e-6
            may = (np.array(t["label"])[:, None] == labels) == same
            may &= (middle - reach - slack <= hi[:, None]) & (middle + reach + slack >= np.maximum(lo, kth)[:, None])
            ids = np.array(t["request"])
            if first:
                promise = np.where(may, -np.abs(np.minimum(hi, 1 << 52)[:, None] - middle), -np.inf)
                best = promise.argmax(axis=1)
                some = np.flatnonzero(may.any(axis=1))
                got = ids[some], names_[best[some]], promise[some, best[some]]
            else:
                may &= names_ != np.array(t["seen"].to_pylist(), object)[:, None]
                r, c = np.nonzero(may)
                got = ids[r], names_[c], np.zeros(len(r))
            out.append(pa.table(dict(zip(names, (pa.array(got[0], pa.int64()), pa.array(got[1], pa.string()), pa.array(got[2], pa.float64())), strict=True))))
        return pa.concat_tables(out)

    return run


def _look(dim: int, k: int):
    empty = pa.table({"request": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    def run(trees: pa.Table, requests: pa.Table) -> pa.Table:
        if not trees.num_rows or not requests.num_rows:
            return empty
        tree = pickle.loads(trees["tree"][0].as_py())
        out = []
        for a in range(0, requests.num_rows, 2048):
            t = requests.slice(a, 2048)
            q = matrix(t["q"], dim)
            best, who = np.repeat(np.array(t["kth"])[:, None], k, axis=1), np.full((len(q), k), NONE, np.int64)  # nothing strictly beneath the first wave's k-th is wanted
            tree.search(q, np.array(t["lo"]), np.array(t["hi"]), np.array(t["own"]), best, who)
            r, c = np.nonzero(who != NONE)
            out.append(pa.table({"request": pa.array(np.array(t["request"])[r], pa.int64()), "vec_id": pa.array(who[r, c], pa.int64()), "score": pa.array(best[r, c], pa.int64())}))
        return pa.concat_tables(out)

    return run


def plant(rows: DataFrame, dim: int, n: int) -> DataFrame:
    """(label, shard, block, centre, radius, tree): a written table of the trees over rows (rid, vec_id, label, v)."""
    sample = rows.select("v", F.xxhash64("rid").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    x = np.unique(matrix(sample["v"], dim, np.float64), axis=0) if sample.num_rows else np.zeros((1, dim))
    chosen, near = [0], np.full(len(x), np.inf)
    for _ in range(min(PIVOTS, max(1, n // SHARD), len(x)) - 1):  # the next pivot is the row farthest from those there are
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(near.argmax()))
    celled = rows.mapInArrow(_nearest(x[chosen]), T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    celled = written(celled, "ball-cells")
    sizes = celled.groupBy("label", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    dealt = celled.join(sizes, ["label", "cell"]).withColumn("shard", F.concat_ws(":", "label", "cell", F.pmod(F.xxhash64("rid"), "parts")))
    schema = T.StructType([T.StructField("label", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType()), T.StructField("tree", T.BinaryType())])
    trees = written(dealt.groupBy("shard").applyInArrow(_plant(dim), schema), "ball-trees")
    dropped(celled)
    return trees


def seek(requests: DataFrame, trees: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """(request, vec_id, score): each request's best k rows of its own label (same) or of all others, with lo <= score <= hi. requests: a written table (request, own, label, q, lo, hi)."""
    blocks = max(1, -(-trees.count() // SUMMARIES))
    supers = max(1, -(-requests.count() // BLOCK))
    summaries = trees.select("label", "shard", "centre", "radius", F.pmod(F.xxhash64("shard"), F.lit(blocks)).cast("int").alias("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(supers - 1))))
    part = F.pmod(F.xxhash64("request"), F.lit(supers)).cast("int").alias("part")
    found_schema = T.StructType([T.StructField("request", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    route_schema = "request long, shard string, promise double"

    def wave(asked: DataFrame, first: bool) -> DataFrame:
        there = asked.select("*", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        routes = there.groupBy("block", "part").cogroup(summaries.groupBy("block", "part")).applyInArrow(_route(dim, same, first), route_schema)
        if first:
            routes = routes.groupBy("request").agg(F.max(F.struct("promise", "shard")).alias("m")).select("request", "m.shard")
        going = asked.join(routes.select("request", "shard"), "request").select("request", "own", "q", "lo", "hi", "kth", "shard", part)
        at = written(going, "ball-routes")
        copies = trees.join(at.select(F.col("shard").alias("at"), F.col("part").alias("to")).distinct(), F.col("shard") == F.col("at")).select("shard", F.col("to").alias("part"), "tree")
        found = copies.groupBy("shard", "part").cogroup(at.groupBy("shard", "part")).applyInArrow(_look(dim, k), found_schema)
        found = written(found.join(at.select("request", F.col("shard").alias("seen")).distinct(), "request") if first else found, "ball-found")
        dropped(at)
        return found

    one = wave(requests.select("*", F.lit(LOW).alias("kth"), F.lit("").alias("seen")), True)
    seen = one.groupBy("request").agg(F.first("seen").alias("seen"), F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    asked = requests.join(seen, "request", "left").select(*requests.columns, F.coalesce("kth", F.lit(LOW)).alias("kth"), F.coalesce("seen", F.lit("")).alias("seen"))
    two = wave(asked, False)
    order = Window.partitionBy("request").orderBy(F.col("score").desc(), "vec_id")
    both = one.select("request", "vec_id", "score").union(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = written(both, "ball-best")
    dropped(one, two)
    return best


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, scale: int = 256, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (an id divisible by ``every``) and each of its best positives, the best rows of other labels that score between ``low`` and ``high`` percent of the positive."""
    rows = need(vectors, **{id_column: T.LongType(), label_column: T.LongType(), vector_column: T.ArrayType(T.DoubleType())}).toDF("vec_id", "label", "x")
    good = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = written(rows.where(good).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")), "ball-rows")
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, dim, top2 = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(length2), F.lit(0.0))).first()
    if top2 >= 2.0**61 / max(low, high, 100):
        raise ValueError(f"scores of vectors of squared length {top2:.3g}, a hundredfold, don't fit 62 bits")
    trees = plant(rows, dim, n)
    anchors = rows.where(F.col("vec_id") % every == 0)
    asked = written(anchors.select(F.col("rid").alias("request"), F.col("rid").alias("own"), "label", F.col("v").alias("q"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")), "ball-anchors")
    pairs = seek(asked, trees, dim, positives, same=True)
    wanted = pairs.join(anchors.select(F.col("rid").alias("request"), F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("q")), "request")
    least = F.expr(f"({low} * score - pmod({low} * score, 100)) div 100 + if(pmod({low} * score, 100) > 0, 1, 0)")
    most = F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    wanted = written(
        wanted.where(least <= most).select(F.monotonically_increasing_id().alias("request"), F.lit(-1).cast("long").alias("own"), "label", "q", least.cast("long").alias("lo"), most.cast("long").alias("hi"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "ball-windows",
    )
    found = seek(wanted.select("request", "own", "label", "q", "lo", "hi"), trees, dim, negatives, same=False)
    out = found.join(wanted.select("request", "anchor_id", "positive_id", "positive_score"), "request")
    dropped(rows, asked, pairs, trees)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
