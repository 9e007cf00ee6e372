"""From predictions to a comparison of runs: temperatures on calibration rows, metrics of each run by group, and runs side by side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..schema import KINDS
from . import metrics

#: The groups of an evaluation.
GROUPS = [[], ["kind"], ["source"], ["language"]]


def tempered(temperatures: dict[str, float] | None) -> Column:
    """Probabilities from logits at the temperature of a row's kind; kinds without one stay as they are."""
    t = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(x))) for k, x in (temperatures or {}).items()), F.lit(1.0))
    return ar.softmax(F.col("logits"), t)


@dataclass
class Calibration:
    temperatures: dict[str, float]
    summary: dict  # n and temperature of each kind, ece and nll before and after


def calibrate(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> Calibration:
    """The temperatures of rows (kind, split, logits, target), all of which must be validation; kinds without rows get 1."""
    if not rows.where("split is distinct from 'validation'").isEmpty():
        raise ValueError("calibration rows must come from validation")
    slim = rows.select("kind", "logits", "target").persist()
    try:
        fitted = metrics.fit_temperatures(slim, list(kinds))
        counts = {r["kind"]: r["n"] for r in slim.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row a kind
        out: dict = {"per_kind": {k: {"n": counts.get(k, 0), "temperature": fitted[k]} for k in kinds}}
        for name, t in (("before", None), ("after", fitted)):
            one = metrics.by_groups(metrics.row_metrics(slim.withColumn("p", tempered(t))), [[]]).first()
            out |= {f"ece_{name}": one["ece"] if one else None, f"nll_{name}": one["nll"] if one else None}
        return Calibration(fitted, out)
    finally:
        slim.unpersist()


def evaluate(rows: DataFrame, temperatures: dict[str, float] | None = None, split: str = "validation", final: bool = False, groups: list[list[str]] = GROUPS) -> DataFrame:
    """Metrics by group of the rows of a split that have logits, with skipped: how many of all rows have none. The test split needs ``final``."""
    asked = metrics.evaluation_rows(rows, split, final)
    seen = asked.where("logits is not null").withColumn("p", tempered(temperatures))
    skipped = asked.agg(F.count_if(F.col("logits").isNull()).alias("skipped"))
    return metrics.by_groups(metrics.row_metrics(seen), groups).join(F.broadcast(skipped), how="cross")


def compare(runs: dict[str, DataFrame], reference: str, sources: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(part, value, run, n, acc, nll, brier, mean_conf, ece, gain): runs side by side.

    Parts are the runs' own groups all and kind; with seen (a table of sources that an audit lists) seen and not_flagged,
    pooled over sources; with sources (a table of chosen ones) selected, pooled over them, and source for each. gain is
    in points of accuracy over the reference run, of the same part and value; ece isn't pooled.
    """
    if reference not in runs:
        raise ValueError(f"no run {reference}; there are {', '.join(sorted(runs))}")
    parts = []
    for name, results in runs.items():
        shown = ["n", "acc", "nll", "brier", "mean_conf"]
        own = results.where(F.col("group_type").isin("all", "kind")).select(F.col("group_type").alias("part"), F.col("group_value").alias("value"), *shown, "ece")
        each = results.where("group_type = 'source'").withColumnRenamed("group_value", "source")
        none = F.lit(None).cast("double").alias("ece")
        if seen is not None:
            own = own.unionByName(metrics.split_by_seen(each, seen).select("part", F.lit("").alias("value"), *shown, none))
        if sources is not None:
            chosen = each.join(sources.select("source").distinct(), "source", "left_semi")
            own = own.unionByName(metrics.pooled(chosen.withColumn("part", F.lit("selected")), ["part"]).select("part", F.lit("").alias("value"), *shown, none))
            own = own.unionByName(chosen.select(F.lit("source").alias("part"), F.col("source").alias("value"), *shown, "ece"))
        parts.append(own.withColumn("run", F.lit(name)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    base = both.where(F.col("run") == reference).select("part", "value", F.col("acc").alias("base_"))
    return both.join(base, ["part", "value"], "left").withColumn("gain", F.when(F.col("run") != reference, 100 * (F.col("acc") - F.col("base_")))).drop("base_")
