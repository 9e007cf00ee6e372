"""N-gram Jaccard join by universe partition.

A document's set is its distinct 4-word shingles as 64-bit hashes. Documents with the same set are one class. Sizes fall
into bands [2^b, 2^(b+1)); the pair of a smaller set in band b and its partner meets in scheme b, so a set enters its own
scheme and, if a partner can be smaller than its band, the one below. Scheme b deals the universe of hashes into m
segments; at a similarity of t two sets differ in at most D hashes, so

* exact allocation: at least m - D segments are equal. In one order of all keys, from rare to frequent, the rarest key
  that both have is among the D + 1 rarest of either, so a set gives only those D + 1 of its m keys. Frequent keys
  (segments that a large group shares, or empty ones) come last and mostly stay out; of equally rare ones the segments
  of most hashes come first, as unrelated texts share those of one hash by chance, the more often the more texts there are;
* one-deletion allocation: with m = D / 2 + 1 segments one differs by a hash at most, so the segments' hashes and those
  of their one-deletion neighbourhoods meet.

The allocation of each band is the cheaper one by keys given and pairs met on a sample of at most ``sample_rows``
documents, which also names at most ``frequent_keys`` frequent keys; neither changes the result.

Pairs of classes that share a key are verified without meeting all pairs of a large group:

1. Each class is compared with the class that it shares most keys with among the most connected of each key, the pivots.
   These links' components settle most keys.
2. The classes of the keys of one pivot that still span components make a group. In a small one (``small`` classes at
   most) all pairs are sifted by sketches, which stay in one task.
3. In a larger group each class is compared with the pivot p, and keeps its difference to p. For two classes
   |A ^ B| = |(A ^ p) ^ (B ^ p)|, so they are linked only if their differences to p differ by D hashes at most. If those
   have nothing in common, both are linked to p. Else, in one order from rare to frequent, the hash that both have first
   stands at positions i and j with i + j <= D, as what stands before it is in one of them only: so the D + 1 rarest
   hashes of each difference are keys with a position, and classes of other components that meet under one within those
   positions are compared. The order (by the least ``hints`` classes of the group, by hash) changes the cost alone.

A sketch has for each of B hash buckets whether an odd number of hashes lies there; two sets differ in at least as many
hashes as their sketches differ in bits, so a pair whose sketches differ in more than D bits isn't linked. All other
pairs are compared exactly on whole sets, which travel once to each block of pairs; a large group is dealt over several.
Sketches come from the pass that gives keys; whole sets (8 bytes a shingle) are made from one copy's text, and only of the
classes of pairs that sketches leave and of large groups.

Defined cases: a null text or one without words has no set, n_shingles 0 and links to nothing; fewer words than a
shingle are one shingle together; repeated rows are one class; documents without an id are left out of components' names
(a class of such documents alone has none); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, dropped, need, release, written
from .components import components
from .wordhash import BASES, Words, mixed, rolled

SHARD_BYTES = 8 << 20
#: Hashes of the sets of a group that go to one block.
BLOCK_HASHES = 1 << 20
#: Texts looked at together.
ROWS = 1024
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


class Measure:
    """Shingles of n words and a similarity of num / den or more."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def differ(self, smaller: int, larger: int) -> int:
        """The most hashes in which sets of these sizes may differ: union >= total / (1 + t), difference = 2 union - total."""
        return (smaller + larger) * (self.den - self.num) // (self.den + self.num)

    def most(self, size: int) -> int:
        """The largest partner of a set."""
        return size * self.den // self.num

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def band(self, b: int) -> int:
        """The most in which a pair of scheme b differs."""
        top = (2 << b) - 1
        return self.differ(top, self.most(top))

    def schemes(self, size: int) -> Iterator[tuple[int, int]]:
        """(scheme, D) for a set of this size."""
        b = size.bit_length() - 1
        own = self.differ(size, self.most(size))
        if own:
            yield b, own
        below = (1 << b) - 1
        if b and self.most(below) >= size:
            yield b - 1, self.differ(below, size)


def sets_of(texts: list[bytes | None], n: int, at_once: int = 4 << 20) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted hashes; empty without words. Texts are hashed some bytes at a time."""
    out, some, held = [], [], 0
    for k, t in enumerate(texts, 1):
        some.append(t)
        held += len(t or b"")
        if held >= at_once or k == len(texts):
            out += _sets(Words(some, lower=True), n)
            some, held = [], 0
    return out


def _sets(w: Words, n: int) -> list[np.ndarray]:
    h = w.hashes()
    grams = rolled(h, n, BASES[0])
    out = []
    for a, e in zip(w.first.tolist(), w.last.tolist(), strict=True):
        if e - a >= n:
            found = np.sort(grams[a : e - n + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
        else:
            out.append(mixed(rolled(h[a:e], e - a, BASES[1])) if e > a else h[:0])
    return out


def class_of(s: np.ndarray) -> int:
    """A set's name."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def sketch(s: np.ndarray) -> bytes:
    """Whether each of 2 to 4 buckets a hash (a power of two) holds an odd number of hashes."""
    buckets = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketch:
    """A sketch as one number, folded to as many buckets as another has."""

    def __init__(self, raw: bytes):
        self.bits, self.folds = 8 * len(raw), {8 * len(raw): int.from_bytes(raw, "little")}

    def at(self, bits: int) -> int:
        if bits not in self.folds:
            x = self.at(2 * bits)
            self.folds[bits] = x >> bits ^ x & ((1 << bits) - 1)
        return self.folds[bits]

    def differ(self, other: Sketch) -> int:
        """Sets of these sketches differ in so many hashes at least."""
        bits = min(self.bits, other.bits)
        return (self.at(bits) ^ other.at(bits)).bit_count()


def segment_of(s: np.ndarray, segments: int) -> np.ndarray:
    return (((s * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(35)) % np.uint64(segments)).astype(np.int64)


def keys(s: np.ndarray, b: int, segments: int, deletions: bool) -> np.ndarray:
    """The keys of a set's segments in a scheme and, with deletions, of all they leave without one hash."""
    at = segment_of(s, segments)
    own = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(segments, np.uint64)
    np.add.at(sums, at, own)
    salt = mixed(np.arange(segments, dtype=np.uint64) + np.uint64((b << 40) + (int(deletions) << 32) + 1))
    out = mixed(sums ^ salt)
    return np.concatenate([out, mixed((sums[at] - own) ^ salt[at])]) if deletions else out


class Plan:
    """How each scheme allocates, and which keys are frequent (sorted, with their counts in the sample)."""

    def __init__(self, measure: Measure, deletions: frozenset[int], frequent: np.ndarray, counts: np.ndarray):
        self.measure, self.deletions, self.frequent, self.counts = measure, deletions, frequent, counts

    def segments(self, b: int, deletions: bool) -> int:
        d = self.measure.band(b)
        return d // 2 + 1 if deletions else (d + 1) + -(-(d + 1) * 7 // 20)

    def chosen(self, s: np.ndarray) -> np.ndarray:
        """All the keys that a set gives."""
        out = []
        for b, d in self.measure.schemes(len(s)) if len(s) else ():
            thin = b in self.deletions
            k = keys(s, b, self.segments(b, thin), thin)
            if not thin:
                seen = np.zeros(len(k), np.int64)
                if len(self.frequent):
                    i = np.minimum(np.searchsorted(self.frequent, k), len(self.frequent) - 1)
                    seen = np.where(self.frequent[i] == k, self.counts[i], 0)
                hashes = np.bincount(segment_of(s, len(k)), minlength=len(k))  # equal for equal keys, so all sets have one order
                k = k[np.lexsort((k, -hashes, seen))[: d + 1]]
            out.append(k)
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_LONG, _BYTES = T.LongType(), T.BinaryType()
_TRIED = schema(b=T.IntegerType(), thin=T.BooleanType(), key=_LONG, cid=_LONG)
_GIVEN = schema(bucket=_LONG, pairs=_BYTES, sizes=_BYTES, members=_BYTES)
#: A class under a key (key, cid, size, n: how many classes have the key), or without a key a document (cid, size, doc_id, place, and for one of its class in a batch the sketch).
_FOUND = schema(key=_LONG, cid=_LONG, size=_LONG, n=_LONG, doc_id=_LONG, place=_LONG, sketch=_BYTES)
_PACK = schema(shard=_LONG, pack=_BYTES)
_SET = schema(cid=_LONG, hashes=_BYTES)
_LINK = schema(a=_LONG, b=_LONG)
_NEAR = schema(bucket=_LONG, pack=_BYTES)
_MET = schema(group=_LONG, a=_LONG, b=_LONG, size=_LONG)


def _tried(measure: Measure, thin_bands: int):
    plan = Plan(measure, frozenset(), np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s in sets_of(batch.column(0).cast(pa.binary()).to_pylist(), measure.n):
                for b, _ in measure.schemes(len(s)) if len(s) else ():
                    for thin in (False, True)[: 1 + (b <= thin_bands)]:
                        k = np.unique(keys(s, b, plan.segments(b, thin), thin)).view(np.int64)
                        rows.append((np.full(len(k), b, np.int32), np.full(len(k), thin), k, np.full(len(k), class_of(s))))
            cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_TRIED.names)

    return run


def allocate(texts: DataFrame, total: int, measure: Measure, sample_rows: int, thin_bands: int = 5, frequent_keys: int = 1 << 20) -> Plan:
    """The plan by a sample; a key is frequent if three classes of the sample have it, the most frequent ones first."""
    every = max(1, -(-total // sample_rows))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).limit(sample_rows).repartition(16)
    found = sample.mapInArrow(_tried(measure, thin_bands), _TRIED).distinct().groupBy("b", "thin", "key").agg(F.count("*").alias("n"))
    often = F.when(~F.col("thin") & (F.col("n") >= 3), F.col("key")).alias("key")
    found = written(found.groupBy("b", "thin", often).agg(F.sum("n").alias("given"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("met")), "jaccard-sample")
    scale = max(1.0, total / sample_rows)
    costs = {(r["b"], r["thin"]): r["given"] + scale * r["met"] for r in found.groupBy("b", "thin").agg(F.sum("given").alias("given"), F.sum("met").alias("met")).collect()}
    thin = frozenset(b for b, t in costs if t and costs[b, True] < costs.get((b, False), 0.0))
    top = found.where("key is not null").orderBy(F.desc("given"), "key").limit(frequent_keys).select("key", F.col("given").alias("n")).toPandas()
    dropped(found)
    k = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(k)
    return Plan(measure, thin, k[order], top["n"].to_numpy(np.int64)[order])


def _parts(of: np.ndarray) -> list[np.ndarray]:
    """The places of each value."""
    order = np.argsort(of, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(of) else []


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _streamed(raw: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(raw.as_buffer())).read_all()


def _given(shared, buckets: int, total: int, sample_rows: int):
    """For each batch (doc_id, place, text) its documents in one row, and a row for each hash range of its classes' keys.

    A key that the sample calls frequent is dealt by class over as many ranges as its share of all rows asks for, so that no range holds all of a hot key.
    """
    a_range = 1 << 20  # classes of one key in one range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        salts = np.maximum(1, plan.counts * max(1, total // sample_rows) // a_range).astype(np.uint64)
        for b in batches:
            cids: list[int | None] = []
            shingles: list[int] = []
            sketches: list[bytes | None] = []
            parts: dict[int, np.ndarray] = {}
            sizes = {}
            for k in range(0, b.num_rows, ROWS):
                for s in sets_of(b.column(2).slice(k, ROWS).cast(pa.binary()).to_pylist(), plan.measure.n):
                    c = class_of(s) if len(s) else None
                    cids.append(c)
                    shingles.append(len(s))
                    new = c is not None and c not in parts
                    sketches.append(sketch(s) if new else None)
                    if new:
                        parts[c], sizes[c] = plan.chosen(s), len(s)
            out = []
            if parts:
                pairs, size = np.empty(sum(map(len, parts.values())), PAIR), np.repeat(np.fromiter(sizes.values(), np.int64, len(sizes)), [len(k) for k in parts.values()])
                pairs["a"] = np.concatenate(list(parts.values()))
                pairs["b"] = np.repeat(np.fromiter(parts, np.uint64, len(parts)), [len(k) for k in parts.values()])
                bucket = pairs["a"] % np.uint64(buckets)
                if len(plan.frequent) and salts.max() > 1:
                    i = np.minimum(np.searchsorted(plan.frequent, pairs["a"]), len(plan.frequent) - 1)
                    salt = np.where(plan.frequent[i] == pairs["a"], salts[i], np.uint64(1))
                    bucket = np.where(salt > 1, mixed(pairs["a"] ^ mixed(pairs["b"] % salt)) % np.uint64(buckets), bucket)
                out = [(int(bucket[p[0]]), pairs[p].tobytes(), size[p].astype("<u4").tobytes(), None) for p in _parts(bucket)]
            members = pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(shingles, pa.int64()), b.column(0), b.column(1), pa.array(sketches, pa.binary())], names=["cid", "size", "doc_id", "place", "sketch"])
            if b.num_rows:
                out.append((b.column(1)[0].as_py() % buckets, None, None, _stream(members)))
            release()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=_GIVEN.names)

    return run


def _shared_keys(shared, total: int, sample_rows: int):
    """The keys of a hash range that several classes have, and the documents of the batches sent there."""

    def run(t: pa.Table) -> pa.Table:
        release()
        plan = shared.value
        kinds = dict(zip(_FOUND.names, [*[pa.int64()] * (len(_FOUND) - 1), pa.binary()], strict=True))
        out = [pa.table({k: pa.array([], v) for k, v in kinds.items()})]
        for raw in t["members"].drop_null():
            m = _streamed(raw)
            none = pa.nulls(m.num_rows, pa.int64())
            out.append(pa.table({"key": none, "cid": m["cid"], "size": m["size"], "n": none, "doc_id": m["doc_id"], "place": m["place"], "sketch": m["sketch"]}))
        raw = t["pairs"].drop_null().to_pylist()
        if raw:
            pairs, size = np.concatenate([np.frombuffer(x, PAIR) for x in raw]), np.concatenate([np.frombuffer(x, "<u4") for x in t["sizes"].drop_null().to_pylist()])
            order = np.lexsort((pairs["b"], pairs["a"]))
            a, b = pairs["a"][order], pairs["b"][order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, size = a[new], b[new], size[order][new]
            start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            n = np.repeat(np.diff(np.append(start, len(a))), np.diff(np.append(start, len(a))))
            if len(plan.frequent):
                i = np.minimum(np.searchsorted(plan.frequent, a), len(plan.frequent) - 1)
                n = np.where(plan.frequent[i] == a, np.maximum(2, plan.counts[i] * max(1, total // sample_rows)), n)  # its classes may lie in several ranges
            a, b, size, n = a[n > 1], b[n > 1], size[n > 1], n[n > 1]
            none = pa.nulls(len(a), pa.int64())
            out.append(pa.table({"key": a.view(np.int64), "cid": b.astype(np.int64), "size": size.astype(np.int64), "n": n.astype(np.int64), "doc_id": none, "place": none, "sketch": pa.nulls(len(a), pa.binary())}))
        return pa.concat_tables(out)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by shard, compressed: a row for each shard in a batch, with equal rows (by place) once."""
    for b in batches:
        if not b.num_rows:
            continue
        _, once = np.unique(b.column(1).to_numpy(zero_copy_only=False), return_index=True)
        shards = b.column(0).to_numpy(zero_copy_only=False)[once]
        out = [(int(shards[p[0]]), _stream(pa.RecordBatch.from_arrays([b.column(1), b.column(2)], names=["place", "text"]).take(pa.array(once[p])))) for p in _parts(shards)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=_PACK.names)


def _wanted_sets(n: int):
    def run(packs: pa.Table, wanted: pa.Table) -> pa.Table:
        release()
        out: dict[int, bytes] = {}
        if packs.num_rows and wanted.num_rows:
            want, places = set(wanted["cid"].to_pylist()), pa.array(wanted["place"].combine_chunks())
            for raw in packs["pack"]:
                t = _streamed(raw)
                t = t.filter(pa.compute.is_in(t["place"], places))
                for s in sets_of(t["text"].cast(pa.binary()).to_pylist(), n):
                    if len(s) and (c := class_of(s)) in want:
                        out[c] = s.tobytes()
        return pa.table({"cid": pa.array(list(out), pa.int64()), "hashes": pa.array(list(out.values()), pa.binary())})

    return run


def _known(sets: pa.Table) -> dict[int, np.ndarray]:
    return {c: np.frombuffer(x.as_buffer(), "<u8") for c, x in zip(sets["cid"].to_pylist(), sets["hashes"], strict=True)}


def _compare(measure: Measure):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        release()
        known = _known(sets)
        links = [(a, b) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True) if measure.linked(known[a], known[b])]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _sift(measure: Measure):
    """The pairs (a, b) that sketches don't rule out."""

    def run(pairs: pa.Table, sketches: pa.Table) -> pa.Table:
        release()
        known = {c: (n, Sketch(x)) for c, n, x in zip(sketches["cid"].to_pylist(), sketches["size"].to_pylist(), sketches["sketch"].to_pylist(), strict=True)}
        keep = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            (m, x), (n, y) = known[a], known[b]
            keep.append(x.differ(y) <= measure.differ(m, n))
        return pairs.select(_MET.names).filter(pa.array(keep, pa.bool_()))

    return run


def _by(t: pa.Table, key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each key of a table, as tuples of columns."""
    out: dict[int, list[tuple]] = {}
    for k, row in zip(t[key].to_pylist(), zip(*(t[c].to_pylist() for c in columns), strict=True), strict=True):
        out.setdefault(k, []).append(row)
    yield from out.items()


def _sift_all(measure: Measure):
    """The pairs of each group's classes of different components that sketches don't rule out."""

    def run(t: pa.Table) -> pa.Table:
        release()
        out = []
        for group, some in _by(t, "group", ("size", "b", "component", "sketch")):
            rows = sorted(((n, b, x, Sketch(raw)) for n, b, x, raw in some), key=lambda r: r[:2])
            for i, (m, a, x, p) in enumerate(rows):
                most = measure.most(m)
                for n, b, y, q in rows[i + 1 :]:
                    if n > most:
                        break
                    if x != y and p.differ(q) <= measure.differ(m, n):
                        out.append((group, a, b, n))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(_MET.names, list(zip(*out, strict=True)) or [()] * 4, strict=True)})

    return run


def _dealt(pairs: DataFrame, blocks: int) -> DataFrame:
    """Pairs (group, a, b, size of b) with their block: a group's meet in one, those of a large group are dealt by b."""
    large = pairs.groupBy("group").agg(F.ceil(F.sum("size") / BLOCK_HASHES).alias("salts")).where("salts > 1")
    dealt = pairs.join(large, "group", "left")
    return dealt.withColumn("block", F.pmod(F.xxhash64("group", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1)))), F.lit(blocks)).cast("long")).drop("salts")


def _asked(dealt: DataFrame) -> DataFrame:
    """The classes of each block's pairs."""
    return dealt.select(F.col("block").alias("at"), F.col("a").alias("cid")).union(dealt.select("block", "b")).distinct()


def _sifted(pairs: DataFrame, sketches: DataFrame, measure: Measure, blocks: int) -> DataFrame:
    """Those of the distinct pairs (group, a, b, size of b) that sketches don't rule out."""
    dealt = written(_dealt(pairs, blocks), "jaccard-pairs")
    found = written(dealt.groupBy("block").cogroup(_asked(dealt).join(sketches, "cid").groupBy("at")).applyInArrow(_sift(measure), _MET), "jaccard-sifted")
    dropped(dealt)
    return found


def _compared(pairs: DataFrame, sets: DataFrame, measure: Measure, blocks: int) -> DataFrame:
    """Those of the distinct pairs (group, a, b, size of b) that are linked."""
    dealt = written(_dealt(pairs, blocks).select("block", "a", "b"), "jaccard-pairs")
    links = written(dealt.groupBy("block").cogroup(_asked(dealt).join(sets, "cid").select("at", "cid", "hashes").groupBy("at")).applyInArrow(_compare(measure), _LINK), "jaccard-links")
    dropped(dealt)
    return links


_ENTRY = np.dtype([("key", "<u8"), ("cid", "<i8"), ("component", "<i8"), ("group", "<i8"), ("at", "<i4"), ("size", "<i4")])


def _prefixes(measure: Measure, p: np.ndarray, members: list[np.ndarray], hints: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each member its difference to p, the rarest hashes first, cut after the D + 1 first ones; and how large the whole differences are."""
    seen = [np.setxor1d(p, s, assume_unique=True) for s in hints]
    common, count = np.unique(np.concatenate(seen), return_counts=True) if seen else (p[:0], np.zeros(0, np.int64))
    out, sizes = [], np.empty(len(members), np.int64)
    for k, s in enumerate(members):
        x = np.setxor1d(p, s, assume_unique=True)
        sizes[k] = len(x)
        often = np.zeros(len(x), np.int64)
        if len(common):
            i = np.minimum(np.searchsorted(common, x), len(common) - 1)
            often = np.where(common[i] == x, count[i], 0)
        out.append(x[np.lexsort((x, often))[: measure.differ(len(s), measure.most(len(s))) + 1]])
    return out, sizes


def _near(measure: Measure, buckets: int):
    """Links of the pairs (a: pivot, b) of a block, and the keys of the differences by hash range."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        release()
        known = _known(sets)
        links, entries = [], []
        for p, some in _by(pairs, "a", ("b", "component", "hint")):
            pivot, members, components = known[p], [b for b, _, hint in some if not hint], [x for _, x, hint in some if not hint]
            found, sizes = _prefixes(measure, pivot, [known[c] for c in members], [known[b] for b, _, hint in some if hint])
            base = mixed(np.array([p], np.int64).view(np.uint64))[0]
            for c, component, x, n in zip(members, components, found, sizes.tolist(), strict=True):
                if n <= measure.differ(len(known[c]), len(pivot)):
                    links.append((p, c))
                e = np.empty(len(x), _ENTRY)
                e["key"], e["cid"], e["component"], e["group"], e["at"], e["size"] = mixed(x ^ base), c, component, p, np.arange(len(x)), len(known[c])
                entries.append(e)
        out = [(-1, np.array(links, np.int64).tobytes())] if links else []
        if entries:
            every = np.concatenate(entries)
            press = zstandard.ZstdCompressor(level=1)
            out += [(int(every["key"][q[0]] % np.uint64(buckets)), press.compress(b"".join(every[c][q].tobytes() for c in _ENTRY.names))) for q in _parts(every["key"] % np.uint64(buckets))]
        return pa.table({"bucket": pa.array([x for x, _ in out], pa.int64()), "pack": pa.array([x for _, x in out], pa.binary())})

    return run


def _entries(raw: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, at = len(data) // _ENTRY.itemsize, 0
    out = np.empty(n, _ENTRY)
    for c in _ENTRY.names:
        out[c] = np.frombuffer(data, _ENTRY[c], n, at)
        at += n * _ENTRY[c].itemsize
    return out


def _meet(measure: Measure):
    """The classes of different components that share a key of their differences at positions that a link allows."""

    def run(t: pa.Table) -> pa.Table:
        release()
        e = np.concatenate([_entries(x) for x in t["pack"].to_pylist()])
        e = e[np.lexsort((e["at"], e["key"]))]
        last = np.searchsorted(e["key"], e["key"], side="right")
        most = np.array([measure.differ(n, measure.most(n)) for n in e["size"].tolist()], np.int64)
        found, k, live = [], 0, np.arange(len(e))
        while len(live):
            k += 1
            live = live[live + k < last[live]]
            live = live[e["at"][live] + e["at"][live + k] <= most[live]]  # positions ascend under a key
            other = live + k
            small, large = np.minimum(e["size"][live], e["size"][other]), np.maximum(e["size"][live], e["size"][other])
            fits = (e["component"][live] != e["component"][other]) & (e["at"][live] + e["at"][other] <= most[other]) & (large.astype(np.int64) * measure.num <= small.astype(np.int64) * measure.den)
            i, j = live[fits], other[fits]
            if len(i):
                swap = e["cid"][i] > e["cid"][j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                found.append(np.column_stack([e["group"][i], e["cid"][i], e["cid"][j], e["size"][j]]))
        rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        return pa.table({c: pa.array(np.ascontiguousarray(rows[:, k])) for k, c in enumerate(_MET.names)})

    return run


def _met_in_differences(pairs: DataFrame, sets: DataFrame, measure: Measure, blocks: int, hints: int) -> tuple[DataFrame, DataFrame]:
    """For pairs (group: a pivot, a: the same, b, size, component of b): (links of these, further pairs to compare)."""
    first = Window.partitionBy("group").orderBy(F.xxhash64("b"))
    hinted = pairs.select("group", "b").withColumn("row", F.row_number().over(first)).where(F.col("row") <= hints).select("group", "b")
    dealt = _dealt(pairs, blocks).withColumn("hint", F.lit(False))
    asked_hints = dealt.select("group", "block").distinct().join(hinted, "group")
    every = written(dealt.select("block", "a", "b", "component", "hint").union(asked_hints.select("block", F.col("group"), "b", F.lit(0).cast("long"), F.lit(True))), "jaccard-pairs")
    near = written(every.groupBy("block").cogroup(_asked(every).join(sets, "cid").select("at", "cid", "hashes").groupBy("at")).applyInArrow(_near(measure, blocks), _NEAR), "jaccard-near")
    links = near.where("bucket < 0").select("pack").mapInArrow(_links, _LINK)
    met = written(near.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet(measure), _MET), "jaccard-met")
    links = written(links, "jaccard-links")
    dropped(every, near)
    return links, met


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            rows = np.frombuffer(raw, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1]))], names=_LINK.names)


def _place(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """A document's place: a hash of its id and text."""
    return F.xxhash64(doc_id, text)


def _classed(rows: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, sample_rows: int = 16384, small: int = 512, hints: int = 256) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The members (doc_id, place, cid, size), a row for each of rows (doc_id, text), the classes: cid, component (their least cid), component_id and n_copies, and the written tables that both read."""
    measure = Measure(shingle, num, den)
    total, size = rows.agg(F.count("text"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-size // SHARD_BYTES))
    shared = rows.sparkSession.sparkContext.broadcast(allocate(rows.where("text is not null").select("text"), total, measure, sample_rows))  # bounded by frequent_keys
    placed = rows.select("doc_id", _place().alias("place"), "text")
    given = placed.mapInArrow(_given(shared, shards, total, sample_rows), _GIVEN)
    found = written(given.groupBy("bucket").applyInArrow(_shared_keys(shared, total, sample_rows), _FOUND), "jaccard-keys")
    entries, members = found.where("key is not null").select("key", "cid", "size", "n"), found.where("key is null").select("doc_id", "place", "cid", "size")

    # Whole sets, which are large, are made from one copy of each class, that of the least place, where sketches don't do.
    copies = members.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("place").alias("place"), F.count("*").alias("n_copies"), F.max("size").alias("size"))
    at = F.pmod(F.col("place"), F.lit(shards)).cast("long").alias("shard")

    def sets_of_classes(cids: DataFrame) -> DataFrame:
        wanted = cids.distinct().join(copies, "cid").select("cid", "place", at)
        packs = placed.where("text is not null").select(at, "place", "text").mapInArrow(_pack, _PACK)
        return written(packs.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_wanted_sets(shingle), _SET), "jaccard-sets")

    sketches = found.where("sketch is not null").select("cid", "size", "sketch").join(entries.select("cid").distinct(), "cid", "left_semi")
    sketches = written(sketches.dropDuplicates(["cid"]), "jaccard-sketches")

    # 1: each class with the most connected class of a key, that of the most keys.
    degree = entries.groupBy("cid").agg(F.sum("n").alias("degree"))
    pivots = entries.join(degree, "cid").groupBy("key").agg(F.max_by("cid", F.struct("degree", "cid")).alias("pivot"))
    pivoted = written(entries.join(pivots, "key").select("key", "cid", "size", "pivot"), "jaccard-pivots")
    tried = pivoted.where("cid <> pivot").groupBy("cid", "pivot").agg(F.count("*").alias("keys"), F.max("size").alias("size"))
    tried = tried.groupBy("cid").agg(F.max_by(F.struct("pivot", "size"), F.struct("keys", "pivot")).alias("m"))
    pairs = _sifted(tried.select(F.col("m.pivot").alias("group"), F.col("m.pivot").alias("a"), F.col("cid").alias("b"), F.col("m.size").alias("size")), sketches, measure, shards)
    sets = sets_of_classes(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")))
    first = _compared(pairs, sets, measure, shards)
    dropped(pairs, sets)
    joined = components(first)

    # 2 and 3: what lies in different components under one key, by pivot.
    spread = pivoted.join(joined.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    spread = written(spread, "jaccard-spread")
    torn = spread.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    groups = written(spread.join(torn, "key").groupBy("pivot", "cid").agg(F.max("size").alias("size"), F.max("component").alias("component")).select(F.col("pivot").alias("group"), F.col("cid").alias("b"), "size", "component"), "jaccard-groups")
    dropped(pivoted, spread)
    large = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")).where((F.col("n") > small) | (F.col("hashes") > 4 * BLOCK_HASHES)).select("group")
    few, many = groups.join(large, "group", "left_anti"), groups.join(large, "group").where("group <> b")
    near = few.join(sketches.select(F.col("cid").alias("b"), "sketch"), "b").withColumn("block", F.pmod(F.xxhash64("group"), F.lit(shards)))
    near = written(near.groupBy("block").applyInArrow(_sift_all(measure), _MET), "jaccard-sifted")
    sets = sets_of_classes(near.select(F.col("a").alias("cid")).union(near.select("b")).union(many.select("b")).union(many.select("group")))
    second, met = _met_in_differences(many.withColumn("a", F.col("group")), sets, measure, shards, hints)
    pairs = near.union(met).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("group").alias("group"), F.max("size").alias("size"))
    third = _compared(pairs.select("group", "a", "b", "size"), sets, measure, shards)
    dropped(groups, near, met, sets, sketches)
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second).union(third))
    dropped(first, second, third, joined)

    named = copies.join(final.withColumnsRenamed({"node": "cid"}), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return members, named.join(least, "component").select("cid", "component", "component_id", "n_copies"), [found, final]


def join(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, sample_rows: int = 16384, **options) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the least id reachable by links) and n_copies (rows with its set)."""
    members, classes, _ = _classed(need(docs, doc_id=T.LongType(), text=T.StringType()), shingle, num, den, sample_rows, **options)
    return members.join(classes.drop("component"), "cid", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one row of each component: that of the least id, rows without an id last, the first by text.

    Rows are told apart by id and text, so different texts under one id are judged apart; of rows alike in both any one
    is kept. Rows without words link to nothing: one of those with the same id is kept, and all without an id. Null,
    empty and very long texts, repeated rows and empty tables are as in ``join``; further columns of any name are kept.
    """
    rows = need(docs, doc_id=T.LongType(), text=T.StringType())
    members, classes, made = _classed(rows, **options)
    placed = members.join(classes.select("cid", "component"), "cid", "left").select("doc_id", "place", "component").distinct()
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    found = placed.join(least, "component", "left").where("doc_id is not null and component is null or component is not null and doc_id <=> least")
    found = written(found.select("doc_id", "component", "place"), "jaccard-found")
    of = found.groupBy("doc_id", "component").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    kept = written(of.where("low = high").select(F.col("low").alias("place")).union(_first_by_text(rows, found, of.where("low < high"))), "jaccard-kept")
    dropped(found, *made)

    # Only here do whole rows move, once: by place they are met and told apart. They lie in a column of their own, so that their columns may have any names.
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    apart = doc_id.isNull() & ~F.coalesce(text.rlike(WORD), F.lit(False))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"), apart.alias("apart"), _place(doc_id, text).alias("place"))
    once = Window.partitionBy("place").orderBy("place")
    one = held.where("not apart").select("held", "place").join(kept, "place").withColumn("row", F.row_number().over(once)).where("row = 1")
    return one.select("held").union(held.where("apart").select("held")).select("held.*")


def _first_by_text(rows: DataFrame, found: DataFrame, several: DataFrame) -> DataFrame:
    """The place of the first text of each (doc_id, component) that has several places; texts are read only if there are any."""
    if several.isEmpty():
        return several.select(F.col("low").alias("place"))
    same = several.select(F.col("doc_id").alias("id"), F.col("component").alias("of"))
    asked = found.join(same, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("component").eqNullSafe(F.col("of"))).select("id", "of", "place")
    met = rows.select(_place().alias("place"), "text").join(asked, "place")
    return met.groupBy("id", "of").agg(F.min(F.struct("text", "place")).alias("first")).select("first.place")
