"""The whole mixture build: evaluation rows first, then training rows through a cascade of first reasons, quotas and selection."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import licenses
from ..functions import text as tx
from ..schema import invalid
from . import guard, render, report, sampling, selection


@dataclass
class Settings:
    """The defaults of a build."""

    max_chars: int = 12_000
    max_options: int = 26
    read_limit: int = 20_000
    per_source_cap: int = 2_000
    total: int = 1_000_000
    alpha: float = 0.5
    eval_caps: dict = field(default_factory=lambda: {"validation": 100, "test": 300, "heldout": 300})
    held_out: list = field(default_factory=list)
    excluded: list = field(default_factory=list)
    without_test: list = field(default_factory=list)
    strip_annotations: bool = False
    guard_long: bool = False
    hex_prints: bool = False  # md5 fingerprints instead of crc32 ones
    seed: int = 0
    sizes: selection.Sizes | None = None  # family caps, floors, named sizes: instead of total and alpha
    work: str | None = None  # a shared folder: the judged training rows are written there once, and all tables read them


def _prepared(df: DataFrame, s: Settings, limit: bool) -> DataFrame:
    """df with reason: read_limit, why a row is invalid, state_too_long or too_many_target_options; options capped."""
    if limit:
        last = sampling.nth(df, "source", "seq", s.read_limit)
        df = df.join(last.withColumnRenamed("seq", "last_"), "source", "left").withColumn("reason", F.when(F.col("seq") > F.col("last_"), "read_limit")).drop("last_")
    else:
        df = df.withColumn("reason", F.lit(None).cast("string"))
    df = df.withColumn("reason", F.coalesce("reason", invalid(), F.when(F.length("state") > s.max_chars, "state_too_long")))
    df = render.cap_options(df, s.max_options, s.seed)
    return df.withColumn("reason", F.coalesce("reason", F.when(F.col("too_many_targets"), "too_many_target_options"))).drop("too_many_targets")


def build(train: DataFrame, evaluation: DataFrame, s: Settings | None = None) -> dict[str, DataFrame]:
    """train, validation, calib, heldout and test tables, the ledger of drops, and all_train (every training row with its reason); with named sizes a train_<name> table for each, and quotas.

    Both inputs are decisions with seq, their order of arrival. Every valid evaluation row guards, whatever its licence.
    """
    s = s or Settings()
    ev = _prepared(evaluation, s, False)
    guards = ev.where(F.col("reason").isNull() | (F.lit(s.guard_long) & F.col("reason").isin("state_too_long", "too_many_target_options")))
    index = guard.build_index(guards, order=F.col("seq"), hex_prints=s.hex_prints)

    held = F.col("source").rlike(tx.glob_regex(s.held_out))
    licence = licenses.reason(F.col("license"))
    ev = ev.withColumn("reason", F.coalesce("reason", F.when(~licenses.allowed(licence), F.concat(F.lit("license:"), licence)), F.when((F.col("split") == "test") & F.col("source").rlike(tx.glob_regex(s.without_test)), "no_test")))
    part = F.when(held, "heldout").when(F.col("split") == "test", "test").when(sampling.split_by(F.col("group_id"), 0.5, s.seed + 9), "calib").otherwise("validation")
    good = ev.where("reason is null").withColumn("part", part)
    out = {p: sampling.bottom_k(good.where(F.col("part") == p), "source", "id", s.eval_caps.get(p, s.eval_caps["validation"]), s.seed + i).drop("part", "reason") for i, p in enumerate(("validation", "calib", "heldout", "test"))}

    tr = _prepared(train, s, True)
    licence = licenses.reason(F.col("license"), strip_annotations=s.strip_annotations)
    tr = tr.withColumn("reason", F.coalesce("reason", F.when(F.col("source").rlike(tx.glob_regex(s.excluded)), "excluded_source"), F.when(~licenses.allowed(licence), F.concat(F.lit("license:"), licence)), F.when(held, "held_out_task")))
    alive = guard.flag_leaks(tr.where("reason is null"), index, hex_prints=s.hex_prints).withColumn("reason", F.col("leak")).drop("leak")
    alive = alive.withColumn("h_", tx.text_hash(F.col("state"), F.col("question"), F.array_join("options", " ")))
    nth = F.row_number().over(Window.partitionBy("h_", F.col("reason").isNull()).orderBy("seq"))
    alive = alive.withColumn("reason", F.coalesce("reason", F.when(nth > 1, "duplicate"))).drop("h_")
    everything = tr.where("reason is not null").unionByName(alive)
    if s.work:
        everything.write.parquet(f"{s.work}/judged")
        everything = everything.sparkSession.read.schema(everything.schema).parquet(f"{s.work}/judged")
    kept = everything.where("reason is null").drop("reason")
    pool = sampling.bottom_k(kept, "source", "id", s.per_source_cap, s.seed + 7)
    if s.sizes:
        sizes = replace(s.sizes, seed=s.seed + 8)
        selected, out["quotas"], out["solved"] = selection.mixture(pool, sizes)
        out["train"] = selected.drop("rank", "sizes")
        out |= {f"train_{name}": selected.where(F.array_contains("sizes", name)).drop("rank", "sizes") for name in sizes.sizes}
    else:
        quota = sampling.quotas(pool.groupBy("source").agg(F.count("*").alias("n")), s.total, s.alpha)
        out["train"] = sampling.weighted_top(pool, quota, F.lit(1.0), seed=s.seed + 8)
    out["all_train"] = everything
    drops = everything.select("dataset", F.lit("train").alias("pass"), "reason").unionByName(ev.select("dataset", F.lit("eval").alias("pass"), "reason"))
    out["ledger"] = report.ledger(drops, ["dataset", "pass"], "reason")
    return out


def check(parts: dict[str, DataFrame]) -> None:
    """Raises if training shares a state or a group with any evaluation table, or calibration and validation share a group."""
    state = lambda df: df.select(tx.text_hash(F.col("state")).alias("h"))
    for p in ("validation", "calib", "heldout", "test"):
        guard.assert_disjoint(state(parts["train"]), state(parts[p]), "h")
        guard.assert_disjoint(parts["train"], parts[p], "group_id")
    guard.assert_disjoint(parts["validation"], parts["calib"], "group_id")


def exclusions(config: dict, others: list[dict] = ()) -> list[str]:
    """The patterns of sources that never enter training: a configuration's own, and what other configurations hold out or exclude; sorted, each once."""
    named = [p for c in others for k in ("held_out_sources", "task_novel_sources", "exclude_sources") for p in c.get(k) or []]
    return sorted({*(config.get("exclude_sources") or []), *named})
