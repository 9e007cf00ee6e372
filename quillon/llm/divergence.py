"""Source divergence audit: how far each source's words are from every other source of its language, and which words make it so.

Documents give the occurrences of terms by (lang, source, term), summed within a task before any shuffle. A language
keeps the terms of enough of its documents. Each kept term has a block (by hash) and a number within it, and a source's
counts in one block are one compressed vector. Sources sit in seats of ``SEAT``; the seats of a language hold a
round-robin tournament: the resident vectors of a seat stay in their partition, cached, and in each round one seat of
each meeting sends its vectors to the other, where all pairs of the two seats are evaluated, in both directions. So a
round moves each vector once at most, a task holds 2 * ``SEAT`` vectors of one block, and a language of n sources takes
about n / ``SEAT`` rounds. Sums over blocks meet in an aggregate. A source's terms are ranked by a heap in each block,
and the heaps' few rows in a window.

With p = 1 + floor(10^9 (count + 2) / (N + 2 V)), the value of a term is floor((p - q)^2 / (p + q)). All of it is whole
numbers: quotients by long division in base 1000, which stays within 64 bits for N up to 9 * 10^15.

Defined cases: null text, lang and source are the empty string; a group without terms, or a language that keeps none,
still meets its peers (value 0 where V is 0) and has no term rows; a language of one source has no pairs; repeated rows
count as often as they come; a text of any length is taken whole, in slices; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, need, scratch, written

SEAT = 8
#: Kept terms in a block, about.
TERMS = 1 << 15
#: Entries that a task holds before it gives its counts out, and bytes of a text looked at together.
HELD, SLICE = 400_000, 1 << 20
#: Terms are runs of ASCII letters, A-Z lower-cased, and of anything beyond ASCII.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches):
    """(lang, source, term, n, docs) of some documents; a null term marks a group that occurs."""
    names = ("lang", "source", "term", "n", "docs")
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    n: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    size, marked = 0, set()

    def out():
        for g, counts in n.items():
            rows = len(counts)
            cols = ([g[0]] * rows, [g[1]] * rows, list(counts), list(counts.values()), [docs[g][t] for t in counts])
            for a in range(0, rows, 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 20_000], k) for c, k in zip(cols, kinds, strict=True)], names)
        n.clear()
        docs.clear()

    for b in batches:
        for text, lang, source in zip(b["text"], b["lang"].to_pylist(), b["source"].to_pylist(), strict=True):
            g = (lang, source)
            marked.add(g)
            raw = text.as_buffer()
            if raw is None or not raw.size:
                continue
            here, own = n.setdefault(g, Counter()), docs.setdefault(g, Counter())
            before, seen, rest, raw = len(here), set(), b"", memoryview(raw)
            for a in range(0, len(raw), SLICE):
                terms = (rest + bytes(raw[a : a + SLICE])).translate(_TERM)
                rest = b""
                if a + SLICE < len(raw):  # a term may go on in the next slice
                    cut = terms.rfind(b" ") + 1
                    terms, rest = terms[:cut], terms[cut:]
                terms = terms.split()
                here.update(terms)
                seen.update(terms)
            own.update(seen)
            size += len(here) - before
        if size > HELD:
            yield from out()
            size = 0
    yield from out()
    if marked:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([g[0] for g in marked], [g[1] for g in marked], [None] * len(marked), [0] * len(marked), [0] * len(marked)), kinds, strict=True)], names)


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 count / total), exactly, by long division in base 1000."""
    q, r = count // total, count % total
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // total, r % total
    return q + 1


def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _packed(top: int):
    """A seat's sources in one block as compressed vectors, each with its best terms by a heap."""

    def run(t: pa.Table) -> pa.Table:
        one = {c: t[c][0].as_py() for c in ("lang", "seat", "block")}
        marks, rest = t.filter(pa.compute.is_null(t["tid"])), t.filter(pa.compute.is_valid(t["tid"])).sort_by([("source", "ascending"), ("tid", "ascending")])
        source = rest["source"].to_pylist()
        edges = np.flatnonzero([True, *(a != b for a, b in zip(source, source[1:], strict=False)), True]) if source else np.array([0])
        span = {source[a]: (int(a), int(e)) for a, e in zip(edges[:-1], edges[1:], strict=True)}
        tid, n, n_lang, terms = np.array(rest["tid"], np.int64), np.array(rest["n"], np.int64), np.array(rest["n_lang"], np.int64), rest["term"]
        rows = []
        for m in marks.sort_by("source").to_pylist():
            a, e = span.get(m["source"], (0, 0))
            total, of_lang = m["total"] + 2 * m["v"], m["lang_total"] + 2 * m["v"]
            best = []
            if e > a:
                p, q = share(n[a:e] + 2, total), share(n_lang[a:e] + 2, of_lang)
                f = np.where(p > q, value(p, q), -1)
                cut = np.partition(f, -top)[-top] if len(f) > top else 0
                some = np.flatnonzero((f >= max(cut, 0)) & (p > q))
                best = heapq.nsmallest(top, ((-int(f[i]), terms[a + int(i)].as_py().encode("utf-8", "surrogatepass")) for i in some))
            body = zlib.compress(np.diff(tid[a:e], prepend=0).astype("<i4").tobytes() + n[a:e].astype("<i8").tobytes(), 1)
            rows.append(one | {"source": m["source"], "total": m["total"], "v": m["v"], "size": m["size"], "vector": body, "best": [{"item": x.decode("utf-8", "surrogatepass"), "value": -s} for s, x in best]})
        return pa.Table.from_pylist(rows, schema=_VECTORS)

    return run


_VECTORS = pa.schema([
    ("lang", pa.string()), ("seat", pa.int32()), ("block", pa.int32()), ("source", pa.string()), ("total", pa.int64()), ("v", pa.int64()), ("size", pa.int64()), ("vector", pa.binary()),
    ("best", pa.list_(pa.struct([("item", pa.string()), ("value", pa.int64())]))),
])
_VECTORS_SPARK = "lang string, seat int, block int, source string, total long, v long, size long, vector binary, best array<struct<item:string,value:long>>"
_MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_MET_SPARK = "lang string, source string, item string, value long"


def _opened(t: pa.Table) -> list[tuple[str, np.ndarray]]:
    """(source, p of each term of the block) of some vectors, which are opened one at a time."""
    out = []
    for r in t.sort_by("source").to_pylist():
        raw = zlib.decompress(r["vector"])
        k = len(raw) // 12
        tid, n = np.cumsum(np.frombuffer(raw, "<i4", k)), np.frombuffer(raw, "<i8", k, offset=4 * k)
        counts = np.full(r["size"], 2, np.int64)
        counts[tid] += n
        out.append((r["source"], share(counts, r["total"] + 2 * r["v"]) if r["size"] else counts))
    return out


def _meetings(lang: str, pairs) -> pa.Table:
    rows = []
    for (a, p), (b, q) in pairs:
        s = int(value(p, q).sum())  # the value of a pair of shares is the same from either side
        rows += [{"lang": lang, "source": a, "item": b, "value": s}, {"lang": lang, "source": b, "item": a, "value": s}]
    return pa.Table.from_pylist(rows, schema=_MET)


def _at_home(t: pa.Table) -> pa.Table:
    """The pairs within a seat."""
    own = _opened(t)
    return _meetings(t["lang"][0].as_py(), ((x, y) for i, x in enumerate(own) for y in own[i + 1 :]))


def _visited(resident: pa.Table, visitors: pa.Table) -> pa.Table:
    """The pairs of a resident seat and the seat that visits it."""
    if not resident.num_rows or not visitors.num_rows:
        return _MET.empty_table()
    own, come = _opened(resident), _opened(visitors)
    return _meetings(resident["lang"][0].as_py(), ((x, y) for x in own for y in come))


def opponent(seat, turn, seats):
    """Whom a seat meets in a turn of a round robin by the circle method: seats play i + j = turn modulo (seats - 1), the odd one out the last seat. An odd number of seats has a bye, an opponent that isn't there."""
    m = seats + F.pmod(seats, F.lit(2)) - 1
    other = F.pmod(turn - seat, m)
    alone = F.pmod(turn * F.floor((m + 1) / 2), m)  # 2 i = turn modulo m
    return F.when(seat == m, alone).when(other == seat, m).otherwise(other).cast("int")


def audit(docs: DataFrame, least: int = 10, top: int = 10, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): each source against every other of its language (part ``pair``), and its ``top`` terms that are more frequent in it than in the language (``term``)."""
    spark = docs.sparkSession
    rows = need(docs, **{text_column: "string", lang_column: "string", source_column: "string"}).toDF("text", "lang", "source")
    rows = rows.select(F.col("text").cast("binary"), *(F.coalesce(c, F.lit("")).cast("binary").alias(c) for c in ("lang", "source")))
    counted = rows.mapInArrow(_counted, "lang binary, source binary, term binary, n long, docs long")
    counted = counted.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")), "n", "docs").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counted, "divergence-counts")
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = kept.drop("docs")
    kept = written(kept, "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("lang_total")).withColumn("blocks", F.ceil(F.col("v") / TERMS).cast("int"))
    langs = written(langs, "divergence-langs")
    place = Window.partitionBy("lang", "block").orderBy("term")
    numbered = kept.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).drop("blocks")
    numbered = written(numbered.withColumn("tid", (F.row_number().over(place) - 1).cast("int")), "divergence-terms")
    entries = counts.where(F.col("term").isNotNull()).select("lang", "source", "term", "n").join(numbered, ["lang", "term"])
    entries = written(entries.select("lang", "source", "block", "tid", "term", "n", "n_lang"), "divergence-entries")
    # groups: few rows, one a source
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"]).na.fill(1, ["blocks"])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("seat", F.floor(order / SEAT).cast("int"))
    groups = written(groups.withColumn("seats", F.max("seat").over(Window.partitionBy("lang")) + 1), "divergence-groups")
    sizes = numbered.groupBy("lang", "block").agg(F.count("*").alias("size"))
    marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sizes, ["lang", "block"], "left").na.fill(0, ["size"])
    none = {"tid": "int", "term": "string", "n": "long", "n_lang": "long"}
    marks = marks.select("lang", "seat", "block", "source", *(F.lit(None).cast(k).alias(c) for c, k in none.items()), "total", "v", "lang_total", "size")
    seated = entries.join(groups.select("lang", "source", "seat"), ["lang", "source"]).select("lang", "seat", "block", "source", *none, *(F.lit(None).cast("long").alias(c) for c in ("total", "v", "lang_total", "size")))
    vectors = written(seated.union(marks).groupBy("lang", "seat", "block").applyInArrow(_packed(top), _VECTORS_SPARK), "divergence-vectors")

    # the tournament: residents stay where they are, visitors come
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    key = ["lang", "seat", "block"]
    resident = vectors.select(*key, "source", "total", "v", "size", "vector").repartition(partitions, *key).persist(StorageLevel.MEMORY_AND_DISK)
    met = scratch(spark, "divergence-met")
    resident.groupBy(*key).applyInArrow(_at_home, _MET_SPARK).write.parquet(f"{met}/turn=0")
    seats = groups.agg(F.max("seats")).first()[0] or 0
    again = spark.read.schema(vectors.schema).parquet(vectors.path_written)  # columns of their own: residents and visitors meet in one plan
    with_seats = again.select(*key, "source", "total", "v", "size", "vector").join(groups.select("lang", "seats").distinct(), "lang")
    for turn in range(seats + seats % 2 - 1 if seats > 1 else 0):
        to = opponent(F.col("seat"), F.lit(turn), F.col("seats"))
        going = with_seats.where((F.col("seats") > 1) & (F.lit(turn) < F.col("seats") + F.pmod("seats", F.lit(2)) - 1)).withColumn("to", to).where("to < seat")
        going = going.select("lang", F.col("to").alias("seat"), "block", "source", "total", "v", "size", "vector")
        resident.groupBy(*key).cogroup(going.groupBy(*key)).applyInArrow(_visited, _MET_SPARK).write.parquet(f"{met}/turn={turn + 1}")
    pairs = spark.read.schema(_MET_SPARK).parquet(*(f"{met}/turn={i}" for i in range((seats + seats % 2 if seats > 1 else 1))))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = vectors.select("lang", "source", F.inline("best")).withColumn("part", F.lit("term"))
    both = pairs.select("lang", "source", "part", "item", "value").union(terms.select("lang", "source", "part", "item", "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).cast("int"))
    out = written(ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)), "divergence-audit")
    resident.unpersist()
    dropped(counts, kept, langs, numbered, entries, groups, vectors)
    return out.select("lang", "source", "part", "item", "value", "rank")
