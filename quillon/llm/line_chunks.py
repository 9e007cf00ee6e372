"""Line dedup by content-defined chunks; DataFrame functions only.

A text is cut into lines and the lines into chunks: a chunk ends after line i if a rolling hash over the hashes of
lines i, i-1 and i-2 is divisible by ``mean_lines``, so a boundary depends on three lines alone and an insertion moves
the boundaries near it only. A chunk of two lines with words or more whose bytes stand elsewhere too is removed
everywhere but at its first place (smallest document id, then smallest text hash, then position).

Chunks meet by a 64-bit hash together with their bytes, so what counts as repeated has been compared byte by byte; two
texts under one hash are told apart by joining on the text itself.

Defined cases: null and empty texts are returned as they are; rows that are alike in id and text count as one and are
judged alike; a text of repeated chunks alone becomes empty; an empty table gives an empty table; further columns of
any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import given_back, held, written

#: The start of a marked line that has a word.
WORD_LINE = r"(?:^|\n)[\x01\x02][\x20\t\x0B\f\r]*[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    """32 bits of a line's md5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


#: Stands before each line in a chunk: the first line, or a later one. Every line has one, so texts may hold these too.
HEAD, TAIL = "\x01", "\x02"


def _chunked(texts: DataFrame, mean_lines: int) -> DataFrame:
    """texts (text, ...) with n_ (lines) and chunks_: strings of marked lines.

    Each array is the plain input of a higher-order function and never captured in a lambda, where it would be built again for each element.
    """
    zero = F.lit(0).cast("long")
    df = texts.withColumn("lines_", F.split("text", "\n", -1)).withColumn("n_", F.size("lines_"))
    df = df.withColumn("hash_", F.transform("lines_", line_hash))
    late = lambda n: F.concat(F.array(*[zero] * n), F.col("hash_"))
    roll = F.zip_with(F.zip_with(late(1), late(2), lambda a, b: F.coalesce(a, zero) + 31 * b), late(3), lambda a, b: F.coalesce(a, zero) + 961 * b)
    heads = F.transform(roll, lambda r, i: (i == 0) | (r % mean_lines == 0))
    marked = F.filter(F.zip_with("lines_", heads, lambda x, h: F.concat(F.when(h, HEAD).otherwise(TAIL), x)), lambda x: x.isNotNull())
    return df.withColumn("chunks_", F.split(F.array_join(marked, "\n"), f"\n(?={HEAD})", -1)).drop("lines_", "hash_")


def _plain(chunk: Column) -> Column:
    """A chunk's lines without their marks."""
    return F.array_join(F.transform(F.split(chunk, "\n", -1), lambda x: F.substring(x, 2, 1 << 30)), "\n")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs held aside, with key_ and text."""
    return held(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th")).alias("key_"), F.col("text").cast("string").alias("text"))


def _multi(texts: DataFrame, mean_lines: int) -> DataFrame:
    """(key_, k, chunk, h): the chunks with two lines with words or more."""
    chunks = _chunked(texts, mean_lines).select("key_", F.posexplode_outer("chunks_").alias("k", "c"))  # outer: a plain one would first filter on the chunks, building them once more
    return chunks.where(F.regexp_count("c", F.lit(WORD_LINE)) > 1).select("key_", "k", F.col("c").alias("chunk"), F.xxhash64("c").alias("h"))


def _removals(texts: DataFrame, mean_lines: int) -> DataFrame:
    """(key_, gone): for each text with repeats, the positions of the chunks to remove."""
    multi = _multi(texts, mean_lines)
    # Bytes are compared here: a row for each distinct text under a hash.
    seen = multi.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("key_", "k")).alias("first"))
    per_hash = seen.groupBy("h").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    per_hash = written(per_hash, "line-repeats")
    found = multi.select("key_", "k", "h").join(per_hash.where("texts = 1").select("h", "first"), "h").where(F.struct("key_", "k") != F.col("first")).select("key_", "k")
    clash = per_hash.where("texts > 1").select("h")
    if not clash.isEmpty():
        again = multi.join(clash, "h").groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("key_", "k")).alias("first")).where("n > 1").select("h", "chunk", "first")
        found = found.unionByName(multi.join(again, ["h", "chunk"]).where(F.struct("key_", "k") != F.col("first")).select("key_", "k"))
    return found.groupBy("key_").agg(F.sort_array(F.collect_set("k")).alias("gone"))


def _marked(docs: DataFrame, mean_lines: int) -> DataFrame:
    """docs held aside, with text_ (what is left of the text), n_lines_ and n_removed_ (lines)."""
    keyed = _keyed(docs)
    gone = _removals(keyed.where("text is not null").select("key_", "text"), mean_lines)
    joined = keyed.join(gone, "key_", "left")
    cut = _chunked(joined, mean_lines)
    marked = F.transform("chunks_", lambda c, k: F.struct(c.alias("c"), F.array_contains("gone", k).alias("gone")))
    kept = F.transform(F.filter(marked, lambda x: ~x["gone"]), lambda x: _plain(x["c"]))
    cut = cut.withColumn("text_", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    lost = F.aggregate(F.filter(marked, lambda x: x["gone"]), F.lit(0), lambda a, x: a + F.size(F.split(x["c"], "\n", -1)))
    return cut.withColumn("n_lines_", F.greatest(F.coalesce("n_", F.lit(0)), F.lit(0)).cast("long")).withColumn("n_removed_", F.when(F.col("gone").isNull(), 0).otherwise(lost).cast("long"))


def mark(docs: DataFrame, mean_lines: int = 4) -> DataFrame:
    """docs with text_ (what is left of the text), n_lines_ and n_removed_ (lines); columns of docs with these names are left out."""
    own = ("text_", "n_lines_", "n_removed_")
    return _marked(docs, mean_lines).select(*(c for c, name in zip(given_back(docs), docs.columns, strict=True) if name not in own), *own)


def dedup(docs: DataFrame, mean_lines: int = 4) -> DataFrame:
    """docs, all columns, with repeated chunks removed from their texts."""
    return _marked(docs, mean_lines).select(*given_back(docs, text=F.col("text_")))
