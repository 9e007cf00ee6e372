"""Quality rules: gradient-boosted trees over document statistics.

Statistics are exact counts over whole texts. The trees are trained here, on a bounded sample of labelled documents
(``sample_rows``, the only bound), with monotonic constraints on the features whose direction is known, and flattened
into numpy node arrays that score a whole Arrow batch at once.

Defined cases: a null or empty text has no words and fails the base rules; without labels of both classes there is no
model and the base rules alone decide; repeated rows are judged alike; further columns of the input are ignored by
``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, given_back, held, need, words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees; -1: more of it never raises the quality, 1: never lowers it, 0: free.
FEATURES = {"words": 0, "mean_word_chars": 0, "symbols_a_word": -1, "dup_lines_a_line": -1, "repeat_share": -1, "distinct_share": 1, "upper_share": -1, "stops_a_word": 0, "digit_share": -1}


def repeated_words(found: list[bytes], n: int = 3) -> tuple[int, int]:
    """(words in n-word windows found twice or more in the text, distinct words)."""
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    ids = np.fromiter((put(w, len(seen)) for w in found), np.int64, len(found))
    if len(ids) < n + 1:
        return 0, len(seen)
    key = ids[: len(ids) - n + 1]
    for i in range(1, n):
        at = ids[i : len(ids) - n + 1 + i]
        if int(key.max()) + 1 > (1 << 62) // (len(seen) + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + at
    order = np.argsort(key, kind="stable")
    run = key[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0, len(seen)
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + n, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum()), len(seen)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The exact base counts and the features of a whole text."""
    text = text or ""
    found = words(text)
    n = len(found)
    chars = len(text) - sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    again, distinct = repeated_words(found)
    ascii_upper = sum(map(str.isupper, text)) if len(text) < 64 else upper(text)
    at_least = max(n, 1)
    return [n, chars, symbols, dup, again], [
        float(n), chars / at_least, symbols / at_least, dup / max(1, len(lines)), again / at_least, distinct / at_least,
        ascii_upper / max(chars, 1), sum(text.count(c) for c in ".,!?;:") / at_least, sum(text.count(c) for c in "0123456789") / max(chars, 1),
    ]


def upper(text: str) -> int:
    """Capital letters: ASCII ones by bytes, the others one by one."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = int(((raw >= 65) & (raw <= 90)).sum())
    return n + (sum(1 for c in text if c > "\x7f" and c.isupper()) if (raw >= 128).any() else 0)


@dataclass
class Trees:
    """Node arrays of all trees; a leaf has feature -1. Children of a leaf are the leaf itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(right, self.right[at], self.left[at])
        return self.base + self.value[at].sum(axis=1)


def train(x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> Trees | None:
    """Boosted trees for the log loss. A split on a constrained feature must order its children, and the midpoint bounds all below."""
    if len(y) == 0 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    nodes: list[list[float]] = []
    roots, f = [], np.full(len(y), base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        at = len(nodes)
        sg, sh = g[rows].sum(), h[rows].sum()
        nodes.append([-1, 0.0, at, at, rate * float(np.clip(-sg / (sh + l2), low, high))])
        best: tuple[float, int, int, float] = (1e-6, -1, 0, 0.0)
        if level < depth:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                hg = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                hh = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                gl, gr = np.clip(-hg / (hh + l2), low, high), np.clip(-(sg - hg) / (sh - hh + l2), low, high)
                gain = -(hg * gl + 0.5 * (hh + l2) * gl**2) - ((sg - hg) * gr + 0.5 * (sh - hh + l2) * gr**2)
                ok = (hh >= least) & (sh - hh >= least)
                if signs[j]:
                    ok &= (gr - gl) * signs[j] >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                whole = np.clip(-sg / (sh + l2), low, high)
                better = float(gain[k] + sg * whole + 0.5 * (sh + l2) * whole**2)
                if better > best[0]:
                    best = (better, j, k, float(gl[k] + gr[k]) / 2)
        if best[1] >= 0:
            _, j, k, mid = best
            goes = binned[rows, j] > k
            a, b = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
            left = grow(rows[~goes], g, h, *a, level + 1)
            right = grow(rows[goes], g, h, *b, level + 1)
            nodes[at][:4] = [j, float(edges[j][k]), left, right]
        return at

    everything = np.arange(len(y))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        roots.append(grow(everything, q - y, q * (1 - q), -np.inf, np.inf, 0))
        table = np.array(nodes)
        tree = Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots[-1:]), 0.0, depth)
        f = f + tree.score(x)
    table = np.array(nodes)
    return Trees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots), base, depth)


_SAMPLE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
_JUDGED = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py())[1] for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4096) -> Trees | None:
    """Trees from at most sample_rows labelled documents, chosen by a hash of their ids."""
    known = need(labels, doc_id=T.LongType(), quality=T.IntegerType()).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = need(docs, doc_id=T.LongType(), text=T.StringType()).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = texts.mapInArrow(_features, _SAMPLE).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = found.join(F.broadcast(sample), "doc_id").orderBy("doc_id").collect()  # sample_rows at most
    if not rows:
        return None
    return train(np.array([r["x"] for r in rows]), np.array([float(r["quality"]) for r in rows]), tuple(FEATURES.values()))


def _judge(trees: Trees | None, threshold: float):
    least = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = [statistics(t.as_py()) for t in b.column(1)]
            base = np.array([x for x, _ in both], np.int64)
            score = trees.score(np.array([x for _, x in both])) if trees else np.full(len(base), 0.0)
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            kept = ~failed & ((score >= least) if trees else True)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(score)], names=_JUDGED.names)

    return run


def judge(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """One row for each document: its base counts, whether the base rules fail it, and whether it is kept."""
    return need(docs, doc_id=T.LongType(), text=T.StringType()).mapInArrow(_judge(trees, threshold), _JUDGED)


def _kept_rows(trees: Trees | None, threshold: float, at: int):
    least = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = [statistics(t.as_py()) for t in b.column(at)]
            base = np.array([x for x, _ in both], np.int64)
            good = (base[:, 0] >= 50) & (100 * base[:, 4] <= 50 * base[:, 0])
            if trees:
                good &= trees.score(np.array([x for _, x in both])) >= least
            yield b.filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, trees: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, all their columns unchanged: one pass, no join."""
    rows = held(docs)
    return rows.mapInArrow(_kept_rows(trees, threshold, docs.columns.index("text")), rows.schema).select(*given_back(docs))
