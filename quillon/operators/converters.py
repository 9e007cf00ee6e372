"""Converters by name: how a collection is read and how its rows become decisions, with a ledger of what each drops.

A converter says its reasons beforehand, so the ledger comes out of the same pass that writes its decisions, as observed
counts; there is no second reading. A reason that ends with "*" stands for all that begin with what is before it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import ingest


@dataclass(frozen=True)
class Converter:
    """read(spark, settings, split) gives upstream rows, convert(rows, settings, split) decisions with drop_reason; reasons(settings) lists what they can be."""

    read: Callable[[SparkSession, dict, str], DataFrame]
    convert: Callable[[DataFrame, dict, str], DataFrame]
    reasons: Callable[[dict], list[str]]


REGISTRY: dict[str, Converter] = {}


def stored(spark: SparkSession, settings: dict, split: str) -> DataFrame:
    """The rows that settings name: a table that is given (rows), or a path and its format, {split} in it replaced; a schema where the format needs one."""
    if "rows" in settings:
        return settings["rows"]
    reader = spark.read.format(settings.get("format", "parquet"))
    return (reader.schema(settings["schema"]) if "schema" in settings else reader).load(settings["path"].replace("{split}", split))


def register(name: str, reasons: Callable[[dict], list[str]], read: Callable = stored):
    def add(convert):
        if name in REGISTRY:
            raise ValueError(f"there is a converter {name} already")
        REGISTRY[name] = Converter(read, convert, reasons)
        return convert

    return add


@register("flat", lambda s: [f"{s['dataset']}_split_column_mismatch", "unknown_kind", "noul_bad_target", "empty_target"])
def flat(rows: DataFrame, s: dict, split: str) -> DataFrame:
    return ingest.flat(rows, split, s["dataset"])


@register("json_columns", lambda s: [f"{s['dataset']}_missing_gold", f"{s['dataset']}_unsupported_type:*", f"{s['dataset']}_empty_target"])
def json_columns(rows: DataFrame, s: dict, split: str) -> DataFrame:
    return ingest.json_columns(rows, s["dataset"], split, s.get("license", "apache-2.0"))


@register("ratings", lambda s: [f"{s['dataset']}_bad_rating", f"{s['dataset']}_empty_target"])
def ratings(rows: DataFrame, s: dict, split: str) -> DataFrame:
    return ingest.ratings(rows, s["dataset"], split, s["index"], s.get("upstream", "train"), s.get("license", "cc-by-4.0"))


@register("intents", lambda s: ["empty_target"])
def intents(rows: DataFrame, s: dict, split: str) -> DataFrame:
    return ingest.intents(rows, s["locale"], {"validation": "dev"}.get(split, split), s.get("n_options", 8), s.get("seed", 0))


@register("nested", lambda s: [f"{s['dataset']}_{x}" for x in ("no_target", "unsupported_shape", "target_id_not_in_criteria", "unsupported_type:*", "score_without_values", "target_id_not_in_documents", "empty_target")])
def nested(rows: DataFrame, s: dict, split: str) -> DataFrame:
    return ingest.nested(rows, s["dataset"], s["license"], split)


def converted(spark: SparkSession, name: str, settings: dict, split: str, limit: int | None = None) -> tuple[DataFrame, Observation, list[str]]:
    """(the decisions that are kept, an observation of the drops, its reasons). The observation has its counts once the decisions have been read to the end; a limit is on upstream rows."""
    if name not in REGISTRY:
        raise ValueError(f"no converter {name}; there are {', '.join(sorted(REGISTRY))}")
    c = REGISTRY[name]
    rows = c.read(spark, settings, split)
    made = c.convert(rows.limit(limit) if limit else rows, settings, split)
    reasons = c.reasons(settings)
    is_ = lambda r: F.col("drop_reason").startswith(r[:-1]) if r.endswith("*") else F.col("drop_reason") == r
    named = [is_(r) for r in reasons]
    other = F.col("drop_reason").isNotNull()
    for x in named:
        other &= ~x
    seen = Observation()
    observed = made.observe(seen, F.count_if(F.col("drop_reason").isNull()).alias("kept"), *(F.count_if(x).alias(f"r{i}") for i, x in enumerate(named)), F.count_if(other).alias("other"))
    return observed.where("drop_reason is null").drop("drop_reason"), seen, reasons


def counted(source: str, seen: Observation, reasons: list[str]) -> list[tuple[str, str, int]]:
    """(source, reason, n) of what an observation has counted, without reasons that didn't occur."""
    counts = seen.get
    return [(source, r, counts[k]) for r, k in [("kept", "kept"), *((r, f"r{i}") for i, r in enumerate(reasons)), ("other", "other")] if counts[k]]


def collected(spark: SparkSession, sources: dict[str, dict], split: str, path: str, limit: int | None = None) -> DataFrame:
    """Writes the decisions of all enabled sources (name: settings with ``converter``) as tables beneath a path, source=<name>, one pass each, and returns the ledger (source, reason, n) of what was kept and dropped."""
    rows = []
    for name, s in sorted(sources.items()):
        if not s.get("enabled", True):
            continue
        kept, seen, reasons = converted(spark, s.get("converter", name), s, split, limit)
        kept.write.mode("overwrite").parquet(f"{path}/source={name}")
        rows += counted(name, seen, reasons)
    return spark.createDataFrame(rows, "source string, reason string, n long")  # a row a reason
