"""Values over steps: running averages as compositions of affine maps, so that a long series is no one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar

#: Maps composed one after another; longer series go over several levels.
SEGMENT = 64


def _sorted(maps: DataFrame, by: list[str]) -> DataFrame:
    return maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("maps"))


def _prefixes(a: Column, b: Column) -> Column:
    """Of each map in maps, what the maps before it make of (a, b), in order."""
    start = F.struct(F.array().cast("array<struct<pos:bigint,a:double,b:double>>").alias("out"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), s["a"].alias("a"), s["b"].alias("b")))).alias("out"), (x["a"] * s["a"]).alias("a"), (x["a"] * s["b"] + x["b"]).alias("b"))
    return F.aggregate("maps", start, step)["out"]


def before(maps: DataFrame, key: str, span: int, segment: int = SEGMENT) -> DataFrame:
    """(key, pos, a, b): for each of a series' maps x -> a x + b the composition of all maps before it, positions being within a span.

    Positions are cut into segments; the segments' own compositions are scanned in the same way, and each segment goes
    on from its prefix. A group holds ``segment`` maps, whatever the length of the series.
    """
    if span <= segment:
        return _sorted(maps, [key]).select(key, F.inline(_prefixes(F.lit(1.0), F.lit(0.0))))
    cut = maps.withColumn("seg", F.floor(F.col("pos") / segment))
    parts = _sorted(cut, [key, "seg"])
    whole = F.aggregate("maps", F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((x["a"] * s["a"]).alias("a"), (x["a"] * s["b"] + x["b"]).alias("b")))
    heads = parts.select(key, F.col("seg").cast("long").alias("pos"), whole.alias("w")).select(key, "pos", "w.a", "w.b")
    up = before(heads, key, -(-span // segment), segment).select(F.col(key).alias("k_"), F.col("pos").alias("s_"), F.col("a").alias("a_"), F.col("b").alias("b_"))
    joined = parts.join(up, (F.col(key) == F.col("k_")) & (F.col("seg") == F.col("s_")))
    return joined.select(key, F.inline(_prefixes(F.col("a_"), F.col("b_"))))


def ema(df: DataFrame, key: str, step: str, value: str, decay: float, start: float = 0.0, segment: int = SEGMENT) -> DataFrame:
    """(key, step, ema): the average after each step of a series, whose decay warms up towards ``decay``. Steps are whole numbers from 0, each once, with gaps or not; rows with a null in any of the three are left out."""
    rows = df.where(F.col(key).isNotNull() & F.col(step).isNotNull() & F.col(value).isNotNull())
    d = ar.ema_decay(F.col(step), decay)
    maps = rows.select(key, F.col(step).cast("long").alias("pos"), d.alias("a"), ((1 - d) * F.col(value)).alias("b"))
    last = maps.agg(F.max("pos")).first()[0]
    prefix = before(maps, key, (last or 0) + 1, segment).select(F.col(key).alias("k_"), F.col("pos").alias("p_"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    both = maps.join(prefix, (F.col(key) == F.col("k_")) & (F.col("pos") == F.col("p_")))
    return both.select(key, F.col("pos").alias(step), (F.col("a") * (F.col("pa") * start + F.col("pb")) + F.col("b")).alias("ema"))
