"""Substring dedup: words covered by a window of words that also starts elsewhere are removed.

1. Each window has an anchor, the least hash of its 8-word grams, so equal windows have equal anchors and few grams are
   anchors. Anchors are counted over all documents.
2. Documents are dealt into shards of bounded text. Each shard gives its windows whose anchor recurs, counted by a 128-bit
   hash of their words, and the words of those anchors. Windows found twice or more are confirmed; an anchor's phrase is
   confirmed by its words, and goes, as it was read from whichever shard, to all shards that hold the anchor.
3. The phrases that come to a shard are compiled into an Aho-Corasick automaton, and all documents of the shard stream
   through it. Only where a phrase is found are windows looked at; the words of the confirmed ones are removed.

Counting sends sorted arrays of hashes, a row for each pair of shard and hash range, in which a hash stands once: a
passage that a third of all rows hold is one entry a shard. No range or shard grows with the input; their number does.

Defined cases: a null text has no words; so has an empty one; texts shorter than a window lose nothing; a repeated row
repeats its windows, so both lose them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need
from .wordhash import BASES, Words, rolled

WINDOW, GRAM = 35, 8
SHARD_BYTES = 8 << 20
#: A word is so many symbols of an automaton, each of 4 bits of its hash, so that no node has more than 16 children.
SYMBOLS = 5
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _slid(x: np.ndarray, k: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each k consecutive entries, by doubling."""
    done = 1
    n = len(x) - k + 1
    while 2 * done <= k:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[:n], x[k - done : k - done + n]) if k > done else x[:n]


def _whole(w: Words) -> np.ndarray:
    """Whether a window starts at each word, up to the last."""
    n = max(0, len(w) - WINDOW + 1)
    return (np.repeat(w.last, w.sizes) - np.arange(len(w)))[:n] >= WINDOW


def _anchors(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, each window's anchor, whether a gram is the anchor of some window)."""
    whole = _whole(w)
    grams = rolled(h, GRAM, BASES[0])
    if not len(whole):
        return grams, grams[:0], np.zeros(len(grams), bool)
    span = WINDOW - GRAM + 1
    least = _slid(grams, span, np.minimum)
    of = np.where(whole, least, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    most = _slid(np.concatenate([pad, of, pad]), span, np.maximum)
    return grams, least, (most == grams) & (most > 0)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with all it returns; pairs are sorted by their two columns, which is many times as fast as sorting records."""
    if keys.dtype != PAIR:
        return np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    order = np.lexsort((keys["b"], keys["a"]))
    a, b = keys["a"][order], keys["b"][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return keys[order[start]], order[start], inverse, np.diff(np.append(start, len(a)))


def _schema(longs: str, binaries: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in longs.split()] + [T.StructField(c, T.BinaryType()) for c in binaries.split()])


#: Hashes found once and more often in a shard; in their second use also anchors (hashes) with their words, a phrase a line.
_KEYS = _schema("bucket shard", "once often")
_FOUND = _schema("bucket shard", "once often anchors phrases")
_BACK = _schema("shard", "keys")
_CONFIRMED = _schema("shard", "keys phrases")
_PACK = T.StructType([T.StructField("shard", T.LongType()), T.StructField("pack", T.BinaryType())])


def _rows(shard: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of a shard's keys by hash range, those found once and those found more often in it apart."""
    found, _, _, counts = _distinct(keys)
    main = found["a"] if found.dtype == PAIR else found
    bucket = (main % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            once = counts[part] == 1
            yield int(bucket[part[0]]), shard, found[part[once]].tobytes(), found[part[~once]].tobytes()


def _anchor_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            shards = b.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(shards, kind="stable")
            w = Words(b.column(1).cast(pa.binary()).take(pa.array(order)).to_pylist())
            grams, _, chosen = _anchors(w, w.hashes())
            at = np.flatnonzero(chosen)
            of = np.repeat(shards[order], w.sizes)[at] if len(at) else np.zeros(0, np.int64)
            out = []
            for shard in np.unique(of):
                lo, hi = np.searchsorted(of, [shard, shard + 1])
                out += _rows(int(shard), grams[at[lo:hi]], buckets)
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=_KEYS.names)

    return run


def _shares(t: pa.Table, dtype: np.dtype) -> Iterator[tuple[int, bytes]]:
    """(shard, sorted hashes) of those hashes of a range that stand twice or more."""
    keys, shards, twice = [], [], []
    for shard, *both in zip(t["shard"].to_pylist(), t["once"].to_pylist(), t["often"].to_pylist(), strict=True):
        for more, raw in enumerate(both):
            k = np.frombuffer(raw or b"", dtype)
            keys.append(k)
            shards.append(np.full(len(k), shard, np.int64))
            twice.append(np.full(len(k), bool(more)))
    keys, shards, twice = np.concatenate(keys), np.concatenate(shards), np.concatenate(twice)
    _, _, inverse, counts = _distinct(keys)
    many = counts > 1
    many[inverse[twice]] = True
    hit = many[inverse]
    keys, shards = keys[hit], shards[hit]
    order = np.argsort(shards, kind="stable")
    for p in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
        if len(p):
            yield int(shards[p[0]]), _distinct(keys[p])[0].tobytes()


def _recurring(t: pa.Table) -> pa.Table:
    out = list(_shares(t, np.dtype("<u8")))
    return pa.table({"shard": pa.array([x for x, _ in out], pa.int64()), "keys": pa.array([x for _, x in out], pa.binary())})


def _confirmed(t: pa.Table) -> pa.Table:
    """The recurring windows of a hash range for each shard, and the phrases of its anchors for each shard that has the anchor."""
    out = [(shard, keys, None) for shard, keys in _shares(t, PAIR)]
    undo, texts, holders = zstandard.ZstdDecompressor(), {}, {}
    for shard, anchors, phrases in zip(t["shard"].to_pylist(), t["anchors"].to_pylist(), t["phrases"].to_pylist(), strict=True):
        if anchors:
            found = np.frombuffer(anchors, "<u8").tolist()
            holders.setdefault(shard, []).extend(found)
            for a, phrase in zip(found, undo.decompress(phrases).split(b"\n"), strict=True):
                if texts.setdefault(a, phrase) != phrase:  # other words under the same hash: both are phrases
                    texts[a] = b"\n".join({*texts[a].split(b"\n"), phrase})
    press = zstandard.ZstdCompressor(level=3)
    out += [(shard, None, press.compress(b"\n".join(map(texts.__getitem__, held)))) for shard, held in holders.items()]
    return pa.table({c: pa.array(x, k) for c, x, k in zip(_CONFIRMED.names, list(zip(*out, strict=True)) or [()] * 3, (pa.int64(), pa.binary(), pa.binary()), strict=True)})


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by shard, compressed: a row for each shard in a batch."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        if not b.num_rows:
            continue
        shards = b.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(shards, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
            sink = pa.BufferOutputStream()
            rows = pa.RecordBatch.from_arrays([b.column(1), b.column(2)], names=["doc_id", "text"]).take(pa.array(part))
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_batch(rows)
            out.append((int(shards[part[0]]), press.compress(sink.getvalue())))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=_PACK.names)


def _unpack(t: pa.Table) -> tuple[list[int | None], list[bytes | None]]:
    ids, texts = [], []
    undo = zstandard.ZstdDecompressor()
    for raw in t["pack"]:
        rows = pa.ipc.open_stream(undo.decompress(raw.as_buffer())).read_all()
        ids += rows["doc_id"].to_pylist()
        texts += rows["text"].cast(pa.binary()).to_pylist()
    return ids, texts


def _known(t: pa.Table, dtype: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in t["keys"].drop_null().to_pylist()]
    return _distinct(np.concatenate(parts))[0] if parts else np.zeros(0, dtype)


def _within(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    if keys.dtype != PAIR:
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys
    a, b = np.ascontiguousarray(known["a"]), np.ascontiguousarray(known["b"])
    ka, kb = np.ascontiguousarray(keys["a"]), np.ascontiguousarray(keys["b"])
    at, out = np.searchsorted(a, ka), np.zeros(len(keys), bool)
    for k in range(int(np.unique(a, return_counts=True)[1].max())):  # as many as share a first half: one
        i = np.minimum(at + k, len(a) - 1)
        out |= (a[i] == ka) & (b[i] == kb)
    return out


def _keys(starts: np.ndarray, h: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), PAIR)
    out["a"], out["b"] = rolled(h, WINDOW, BASES[0])[starts], rolled(h2, WINDOW, BASES[1])[starts]
    return out


def _window_rows(buckets: int):
    def run(packs: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if packs.num_rows and anchors.num_rows:
            shard, known = packs["shard"][0].as_py(), _known(anchors, np.dtype("<u8"))
            w = Words(_unpack(packs)[1])
            h = w.hashes()
            grams, of, chosen = _anchors(w, h)
            starts = np.flatnonzero(_whole(w) & _within(of, known)) if len(of) else np.zeros(0, np.int64)
            if len(starts):
                out = [(*r, None, None) for r in _rows(shard, _keys(starts, h, w.hashes(1)), buckets)]
                at = np.flatnonzero(chosen)
                at = at[_within(grams[at], known)]
                found, first = np.unique(grams[at], return_index=True)
                a, e, data = w.starts[at[first]], w.ends[at[first] + GRAM - 1], w.data.tobytes()
                phrases = [b" ".join(data[x:y].split()) for x, y in zip(a.tolist(), e.tolist(), strict=True)]
                press, bucket = zstandard.ZstdCompressor(level=3), (found % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    out.append((int(bucket[p[0]]), shard, None, None, found[p].tobytes(), press.compress(b"\n".join([phrases[i] for i in p.tolist()]))))
        kinds = [pa.int64()] * 2 + [pa.binary()] * 4
        return pa.table({c: pa.array(x, k) for c, x, k in zip(_FOUND.names, list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)})

    return run


def _symbols(h: np.ndarray) -> str:
    """The words of these hashes as symbols; a symbol says which part of its word it is, so that a phrase is found at words' starts only."""
    parts = [(h >> np.uint64(4 * k)).astype(np.uint8) & np.uint8(15) | np.uint8(16 * k + 48) for k in range(SYMBOLS)]
    return np.column_stack(parts).tobytes().decode("latin-1")


def located(h: np.ndarray, phrases: list[bytes]) -> np.ndarray:
    """Where the phrases start in a stream of words (hashes), found by an Aho-Corasick automaton."""
    if not phrases or not len(h):
        return np.zeros(0, np.int64)
    string = _symbols(Words(phrases).hashes())
    automaton, step = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), GRAM * SYMBOLS
    for k in range(0, len(string), step):
        automaton.add_word(string[k : k + step])
    automaton.make_automaton()
    return np.fromiter((end for end, _ in automaton.iter(_symbols(h))), np.int64) // SYMBOLS - (GRAM - 1)


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def _locate(packs: pa.Table, confirmed: pa.Table) -> pa.Table:
    ids, texts = _unpack(packs) if packs.num_rows else ([], [])
    w = Words(texts)
    gone = np.zeros(len(w), bool)
    known = _known(confirmed, PAIR) if confirmed.num_rows else np.zeros(0, PAIR)
    if len(known):
        undo, h = zstandard.ZstdDecompressor(), w.hashes()
        hits = located(h, [p for raw in confirmed["phrases"].drop_null().to_pylist() for p in undo.decompress(raw).split(b"\n")])
        # Windows that hold a phrase found start from 27 words before it up to it.
        near = np.zeros(len(w) + 1, np.int64)
        np.add.at(near, np.maximum(hits - (WINDOW - GRAM), 0), 1)
        np.add.at(near, hits + 1, -1)
        whole = _whole(w)
        starts = np.flatnonzero(whole & (np.cumsum(near)[: len(whole)] > 0))
        starts = starts[_within(_keys(starts, h, w.hashes(1)), known)] if len(starts) else starts
        covered = np.zeros(len(w) + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + WINDOW, -1)
        gone = np.cumsum(covered[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(gone)])
    lost = sums[w.last] - sums[w.first] if len(texts) else np.zeros(0, np.int64)
    kept = [(w.text(i, ~gone) if n else b" ".join((t or b"").split())) for i, (t, n) in enumerate(zip(texts, lost.tolist(), strict=True))]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(w.sizes), "n_removed": pa.array(lost), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def dedup(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed and kept, the words that are left joined by one space."""
    rows = need(docs, doc_id=T.LongType(), text=T.StringType())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    buckets = max(1, shards // 2)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("long").alias("shard"), "doc_id", "text")
    anchors = dealt.where("text is not null").select("shard", "text").mapInArrow(_anchor_rows(buckets), _KEYS)
    anchors = anchors.groupBy("bucket").applyInArrow(_recurring, _BACK)
    found = dealt.mapInArrow(_pack, _PACK).groupBy("shard").cogroup(anchors.groupBy("shard")).applyInArrow(_window_rows(buckets), _FOUND)
    confirmed = found.groupBy("bucket").applyInArrow(_confirmed, _CONFIRMED)
    return dealt.mapInArrow(_pack, _PACK).groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInArrow(_locate, _OUT)
