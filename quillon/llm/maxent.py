"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(slot | class, history) P(word | slot). Classes come from a word's last letters,
slots from its hash, and words of one slot share it by their counts. The first two factors are maximum-entropy models: the
logits of a softmax are the logs of training counts plus a weight row for each active feature, an n-gram or skip feature
of the three tokens before, hashed into a table of fixed size. The chance of an unknown word is the share of words that
training has seen once, so probabilities over known words and "unknown" sum to 1.

How it runs: texts are encoded once, in chunks with a dictionary each. Dictionaries meet by word, where training counts
add up (a word has a row for each chunk that holds it), and each chunk gets the counts of its own words back, for
scoring; no vocabulary is held by anyone. Training deals the chunks to rounds: in each round every task goes through its chunks in minibatches from the round's weights (numpy, sparse rows, row-wise
adaptive steps) and gives its change of each row; changes are averaged by block of rows, weighted by how much a task
had to say about a row. Every training document is used, once. Scoring goes through all chunks with the last weights.
Only weights (``ROWS`` rows of ``WIDTH`` numbers, 6 MB whatever the input) and counts by slot pass through the driver.

Defined cases: a null text is empty and has its end token alone; a null id counts as the empty string; repeated rows
are documents of their own; texts of any length are taken whole, in slices; without training documents every token is
unknown and scores 0 in both models; an empty table gives no rows; further columns are ignored. Chunks follow the files
that Spark reads, so other splits of the input give slightly other weights, and other scores; base scores, and reruns over the
same splits, agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash
from .common import dropped, need, release, written

WIDTH = 32
BITS = WIDTH.bit_length() - 1
ROWS = (1 << 14, 1 << 15)
BLOCK = 1024
BATCH = 1 << 14
RATE = 0.6
#: Weights stay within this, so that four of them and a bias can neither overflow nor vanish in single precision.
MOST = 15.0
ROUNDS = 4
#: Tokens of a chunk, about, and bytes of a text looked at together.
CHUNK, SLICE = 1 << 22, 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_START = np.uint64(0x5851F42D4C957F2D)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
_ZSTD = "zstd"


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def squeeze(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec=_ZSTD, asbytes=True)


def loosen(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec=_ZSTD, asbytes=True), kind) if n else np.zeros(0, kind)


def places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and its slot (class * WIDTH + slot). The class is that of its last two bytes."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    data = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.empty(len(words), np.uint64)
    full = ends > starts
    h[full] = wordhash.runs(data, starts[full], ends[full], 0)
    h[~full] = np.uint64(1)  # the end token
    last, before = data[np.maximum(ends - 1, 0)].astype(np.uint64), data[np.maximum(ends - 2, 0)].astype(np.uint64)
    suffix = np.where(full, last + np.uint64(256) * np.where(ends - starts > 1, before, 0), np.uint64(0))
    kind = wordhash.mixed(suffix + np.uint64(7)) >> np.uint64(64 - BITS)
    return h, (kind * np.uint64(WIDTH) + (h >> np.uint64(64 - BITS))).astype(np.int32)


_ENCODED = pa.schema([
    ("round", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("distinct", pa.int32()), ("ids", pa.binary()), ("h", pa.binary()), ("leaf", pa.binary()),
    ("words", pa.list_(pa.binary())), ("n", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())),
])
_ENCODED_SPARK = "round int, chunk long, doc_id array<long>, sizes array<int>, held array<boolean>, distinct int, ids binary, h binary, leaf binary, words array<binary>, n array<long>, place array<int>"


def _encoded(batches, rounds: int = ROUNDS):
    """Chunks of documents: ids of their tokens in the chunk's own dictionary, which is given with hashes, places and training counts."""
    where = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
    at, numbers = 0, _Numbers()
    docs: list[tuple] = []
    parts: list[np.ndarray] = []
    held_tokens = 0

    def out() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        sizes = np.array([d[1] for d in docs])
        words = list(numbers)
        counts = np.bincount(ids[np.repeat([not d[2] for d in docs], sizes)], minlength=len(words))
        h, leaf = places(words)
        chunk = where + at
        turn = int(wordhash.mixed(np.array([chunk], np.uint64))[0] % np.uint64(rounds))
        row = {"round": turn, "chunk": chunk, "doc_id": [d[0] for d in docs], "sizes": sizes, "held": [d[2] for d in docs], "distinct": len(words), "ids": squeeze(ids), "h": squeeze(h), "leaf": squeeze(leaf), "words": words, "n": counts, "place": leaf}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _ENCODED], schema=_ENCODED)

    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            raw, rest, n = text.as_buffer(), b"", 0
            raw = memoryview(raw) if raw is not None else b""
            for a in range(0, len(raw), SLICE):
                piece = (rest + bytes(raw[a : a + SLICE])).translate(_LOWER)
                rest = b""
                if a + SLICE < len(raw):  # a word may go on in the next slice
                    whole = piece[: -len(piece.split()[-1])] if piece.split() and not piece[-1:].isspace() else piece
                    piece, rest = whole, piece[len(whole) :]
                words = piece.split()
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                n += len(words)
            parts.append(np.array([numbers[b""]], np.int32))
            docs.append((doc_id, n + 1, zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0))
            held_tokens += n + 1
            if held_tokens >= CHUNK:
                yield out()
                at, numbers, docs, parts, held_tokens = at + 1, _Numbers(), [], [], 0
    if docs:
        yield out()


def _counted(t: pa.Table) -> pa.Table:
    """A chunk's training counts over all chunks, in the order of its dictionary."""
    t = t.sort_by("lid")
    return pa.table({"chunk": t["chunk"][:1], "c": pa.array([squeeze(np.array(t["c"], np.int64))], pa.binary())})


class Model:
    """Weights over the counts of training: mass of each slot, all tokens n, distinct words v, words seen once."""

    def __init__(self, mass: np.ndarray, n: int, v: int, once: int):
        self.n, self.v = n, v
        self.unknown = (once + 0.1) / (n + 0.1 * (v + 1))
        self.mass = mass.astype(np.float64)
        by_class = self.mass.reshape(WIDTH, WIDTH)
        with np.errstate(divide="ignore"):
            first, second = np.log(by_class.sum(axis=1)), np.log(by_class)
        first, second = first - max(first.max(), -700), second - np.maximum(second.max(axis=1, keepdims=True), -700)
        self.first, self.second = np.maximum(first, -20).astype(np.float32), np.maximum(second, -20).astype(np.float32)
        self.w = [np.zeros((r, WIDTH), np.float32) for r in ROWS]
        self.a = [np.ones(r, np.float32) for r in ROWS]  # of the adaptive steps
        self.room: list[np.ndarray] = []

    @staticmethod
    def features(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, kind: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of the active features: n-grams of one and two tokens, and tokens two and three back alone; in a class, the last token and the one before."""
        s1, s2 = (np.uint64(65 - r.bit_length()) for r in ROWS)
        one = [(h1 * _ODD[0]) >> s1, (((h1 * _ODD[1]) ^ h2) * _ODD[2]) >> s1, (h2 * _ODD[3]) >> s1, (h3 * _ODD[4]) >> s1]
        k = (kind.astype(np.uint64) + np.uint64(1)) * _ODD[5]
        two = [((h1 ^ k) * _ODD[6]) >> s2, ((h2 ^ k) * _ODD[7]) >> s2]
        return [x.view(np.int64) for x in one], [x.view(np.int64) for x in two]

    def _softmax(self, table: int, rows: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits, and their sums."""
        n = len(rows[0])
        if not self.room or len(self.room[0]) < n:
            self.room = [np.empty((max(n, BATCH), WIDTH), np.float32) for _ in range(2)]
        z, more = (x[:n] for x in self.room)
        np.take(self.w[table], rows[0], axis=0, out=z, mode="clip")
        for r in rows[1:]:
            z += np.take(self.w[table], r, axis=0, out=more, mode="clip")
        z += bias
        np.exp(z, out=z)
        return z, z @ np.ones(WIDTH, np.float32)

    def log10(self, leaf: np.ndarray, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
        """log10 of P(slot | history) for known words."""
        kind, slot, i = leaf >> BITS, leaf & (WIDTH - 1), np.arange(len(leaf))
        one, two = self.features(h1, h2, h3, kind)
        z, s = self._softmax(0, one, self.first)
        out = np.log10(z[i, kind].astype(np.float64) / s)
        z, s = self._softmax(1, two, self.second[kind])
        return out + np.log10(z[i, slot].astype(np.float64) / s)

    def learn(self, leaf: np.ndarray, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> None:
        """One minibatch: the gradient of each row, a sum over the tokens that have its feature, and a step."""
        kind, slot, i = leaf >> BITS, leaf & (WIDTH - 1), np.arange(len(leaf))
        for table, rows, bias, hit in zip((0, 1), self.features(h1, h2, h3, kind), (self.first, self.second[kind]), (kind, slot), strict=True):
            z, s = self._softmax(table, rows, bias)
            z /= s[:, None]
            z[i, hit] -= 1
            g = np.zeros((WIDTH, ROWS[table]))
            for column, x in zip(g, np.ascontiguousarray(z.T, np.float64), strict=True):
                for r in rows:
                    column += np.bincount(r, weights=x, minlength=ROWS[table])
            g = g.astype(np.float32)
            w, a = self.w[table], self.a[table]
            a += np.einsum("ij,ij->j", g, g) / 4
            g *= RATE / np.sqrt(a)
            w -= g.T
            np.clip(w, -MOST, MOST, out=w)


def _opened(r: dict) -> tuple:
    """(ids, sizes, held, h, leaf) of a chunk."""
    sizes, d = np.array(r["sizes"], np.int64), r["distinct"]
    return loosen(r["ids"], int(sizes.sum()), "<i4"), sizes, np.array(r["held"], bool), loosen(r["h"], d, "<u8"), loosen(r["leaf"], d, "<i4")


def _histories(ids: np.ndarray, sizes: np.ndarray, h: np.ndarray):
    """Slices of token positions with the hashes of the three tokens before each, in its own document."""
    firsts = np.cumsum(sizes) - sizes
    for a in range(0, len(ids), BATCH):
        at = np.arange(a, min(a + BATCH, len(ids)))
        lo = np.searchsorted(firsts, a, side="right") - 1
        doc = np.searchsorted(firsts[lo:], at, side="right") - 1 + lo
        deep = at - firsts[doc]
        yield at, [np.where(deep >= k, h[ids[np.maximum(at - k, 0)]], _START) for k in (1, 2, 3)]


def _train(sent):
    def run(batches):
        model: Model = sent.value
        before = [w.copy() for w in model.w], [a.copy() for a in model.a]
        start = model.w, model.a
        model.w, model.a = [w.copy() for w in before[0]], [a.copy() for a in before[1]]
        for b in batches:
            for j in range(b.num_rows):
                ids, sizes, held, h, leaf = _opened(b.slice(j, 1).to_pylist()[0])
                use = np.repeat(~held, sizes)
                for at, back in _histories(ids, sizes, h):
                    keep = use[at]
                    if keep.any():
                        model.learn(leaf[ids[at[keep]]], *(x[keep] for x in back))
        for t in range(2):
            for k in range(0, ROWS[t], BLOCK):
                da = model.a[t][k : k + BLOCK] - before[1][t][k : k + BLOCK]
                if da.any():
                    dw = model.w[t][k : k + BLOCK] - before[0][t][k : k + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([t * 1000 + k // BLOCK], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([squeeze(dw.astype(np.float16))], pa.binary()), pa.array([squeeze(da)], pa.binary())], ["block", "task", "dw", "da"])
        model.w, model.a = start
        release()

    return run


def _mixed(t: pa.Table) -> pa.Table:
    """One block's change: the mean of tasks' changes, each row weighted by what the task's gradients summed to."""
    dw, da, da2 = np.zeros((BLOCK, WIDTH)), np.zeros(BLOCK), np.zeros(BLOCK)
    t = t.sort_by("task")
    for i in range(t.num_rows):
        a = loosen(t["da"][i].as_py(), BLOCK, "<f4").astype(np.float64)
        dw += loosen(t["dw"][i].as_py(), BLOCK * WIDTH, "<f2").reshape(BLOCK, WIDTH) * a[:, None]
        da, da2 = da + a, da2 + a * a
    least = np.maximum(da, 1e-30)
    return pa.table({"block": t["block"][:1], "dw": pa.array([squeeze((dw / least[:, None]).astype(np.float32))], pa.binary()), "da": pa.array([squeeze((da2 / least).astype(np.float32))], pa.binary())})


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(sent):
    def run(chunks: pa.Table, counts: pa.Table) -> pa.Table:
        if not chunks.num_rows:
            return _SCORES.empty_table()
        model: Model = sent.value
        r = chunks.to_pylist()[0]
        ids, sizes, held, h, leaf = _opened(r)
        c = loosen(counts["c"][0].as_py(), len(h), "<i8")
        base = np.log10((c + 0.1) / (model.n + 0.1 * (model.v + 1)))
        within = np.log10(np.where(c > 0, c, 1) / np.maximum(model.mass[leaf], 1)) + np.log10(max(1 - model.unknown, 1e-300))
        lp = np.full(len(ids), np.log10(model.unknown))
        for at, back in _histories(ids, sizes, h):
            keep = c[ids[at]] > 0
            if keep.any():
                i = ids[at[keep]]
                lp[at[keep]] = model.log10(leaf[i], *(x[keep] for x in back)) + within[i]
        firsts = np.cumsum(sizes) - sizes
        cols = (r["doc_id"], held, sizes, np.add.reduceat((c > 0)[ids].astype(np.int64), firsts), np.full(len(sizes), model.n), np.add.reduceat(base[ids], firsts), np.add.reduceat(lp, firsts))
        release()
        return pa.table([pa.array(x, f.type) for x, f in zip(cols, _SCORES, strict=True)], schema=_SCORES)

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    rows = need(docs, **{id_column: "long", text_column: "string"}).toDF("doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    encoded = written(rows.mapInArrow(lambda batches: _encoded(batches, rounds), _ENCODED_SPARK), "maxent-encoded", "round")
    entries = encoded.select("chunk", F.posexplode(F.arrays_zip("words", "n", "place")).alias("lid", "e")).select("chunk", "lid", "e.*")
    same = Window.partitionBy("words")
    summed = entries.select("chunk", "lid", "place", F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("chunk")) == 1).alias("first"))
    summed = written(summed, "maxent-summed")
    once_each = summed.where("first and c > 0")
    n, v, once = once_each.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    mass = np.zeros(WIDTH * WIDTH)
    for leaf, m in once_each.groupBy("place").agg(F.sum("c")).collect():  # a row a slot
        mass[leaf] = m
    counts = written(summed.select("chunk", "lid", "c").groupBy("chunk").applyInArrow(_counted, "chunk long, c binary"), "maxent-counts")
    dropped(summed)
    model = Model(mass, n, v, once)
    tokens = encoded.select("round", "chunk", "doc_id", "sizes", "held", "distinct", "ids", "h", "leaf")
    for turn in range(rounds if n else 0):
        sent = spark.sparkContext.broadcast(model)
        change = tokens.where(F.col("round") == turn).mapInArrow(_train(sent), "block int, task int, dw binary, da binary")
        change = change.groupBy("block").applyInArrow(_mixed, "block int, dw binary, da binary")
        for r in change.toArrow().to_pylist():  # a block each: as many as the tables have, whatever the input
            t, k = divmod(r["block"], 1000)
            part = slice(k * BLOCK, (k + 1) * BLOCK)
            model.w[t][part] += loosen(r["dw"], BLOCK * WIDTH, "<f4").reshape(BLOCK, WIDTH)
            model.a[t][part] += loosen(r["da"], BLOCK, "<f4")
        sent.unpersist()
    sent = spark.sparkContext.broadcast(model)
    found = tokens.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_scored(sent), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = written(found, "maxent-scores")
    dropped(encoded, counts)
    return out
