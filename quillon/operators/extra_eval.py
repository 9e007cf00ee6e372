"""The build of an additional evaluation set: sources that training doesn't have, without leaks, that ask what training hasn't."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import licenses
from ..functions import text as tx
from ..schema import invalid
from . import guard, novelty, render, sampling


@dataclass
class Settings:
    """The defaults of a build."""

    min_eval: int = 150
    per_source: int | None = 400
    max_chars: int = 12_000
    max_options: int = 26
    min_repeat: int = 20
    repeat: float = 0.5
    seen: float = 0.1
    overlap: float = 0.3
    seed: int = 0
    hex_prints: bool = False


def screened(candidates: DataFrame, trained: DataFrame, s: Settings) -> DataFrame:
    """candidates with reason, the first that holds: a licence, a source of training, or an invalid or too long row; options capped."""
    licence = licenses.reason(F.col("license"))
    rows = candidates.withColumn("invalid_", invalid().isNotNull() | (F.length("state") > s.max_chars))
    rows = render.cap_options(rows, s.max_options, s.seed)
    rows = rows.join(trained.select("source").distinct().withColumn("trained_", F.lit(True)), "source", "left")
    why = F.when(~licenses.allowed(licence), F.concat(F.lit("licence:"), licence)).when(F.col("trained_"), "source_in_training_mixture").when(F.col("invalid_") | F.col("too_many_targets"), "invalid_or_too_long")
    return rows.withColumn("reason", why).drop("invalid_", "trained_", "too_many_targets")


def scores(kept: DataFrame, trained: DataFrame, min_repeat: int) -> DataFrame:
    """For each candidate source: n_rows, and the shares of rows whose option set is common in it (repeat_fraction) or trained on (seen_fraction), and of its distinct options that training has (string_overlap)."""
    sets = kept.withColumn("set", novelty.option_set(F.col("options"))).groupBy("source", "set").agg(F.count("*").alias("n"))
    theirs = trained.select(novelty.option_set(F.col("options")).alias("set")).distinct()
    marked = sets.join(theirs.withColumn("seen_", F.lit(True)), "set", "left")
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) / F.sum("n")
    rows = marked.groupBy("source").agg(F.sum("n").alias("n_rows"), share(F.col("n") >= min_repeat).alias("repeat_fraction"), share(F.col("seen_")).alias("seen_fraction"))
    strings = lambda df, *by: df.select(*by, F.explode(F.split("set", "\x1f", -1)).alias("s")).distinct()
    met = strings(sets, "source").join(strings(theirs).withColumn("in_", F.lit(1.0)), "s", "left")
    return rows.join(met.groupBy("source").agg(F.avg(F.coalesce("in_", F.lit(0.0))).alias("string_overlap")), "source")


def build(candidates: DataFrame, trained: DataFrame, s: Settings | None = None) -> dict[str, DataFrame]:
    """rows (of the chosen sources), sources (each with its scores, why it is rejected, and the trained source it resembles) and drops (reason, n).

    Sources are cut to ``per_source`` rows by hash before the costly leak filter; with None, all rows go through it.
    """
    s = s or Settings()
    rows = screened(candidates, trained, s)
    pool = rows.where("reason is null").drop("reason")
    if s.per_source is not None:
        pool = sampling.bottom_k(pool, "source", "id", s.per_source, s.seed)
    filtered = guard.leak_filter(pool, trained, hex_prints=s.hex_prints).persist()
    kept = filtered.where("leak is null").drop("leak")
    per = scores(kept, trained, s.min_repeat)
    rules = ((F.col("n_rows") < s.min_eval, "n_rows"), (F.col("repeat_fraction") < s.repeat, "repeat_fraction"), (F.col("seen_fraction") > s.seen, "seen_fraction"), (F.col("string_overlap") > s.overlap, "string_overlap"))
    per = per.withColumn("rejected", F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in rules)))
    alike = novelty.familiar(per.select(F.col("source").alias("name")), trained.select(F.col("source").alias("name")).distinct())
    per = per.join(alike.withColumnRenamed("name", "source"), "source")
    chosen = kept.join(per.where("rejected is null").select("source"), "source", "left_semi")
    drops = rows.select("reason").union(filtered.select("leak")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return {"rows": chosen, "sources": per, "drops": drops}
