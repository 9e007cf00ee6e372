"""Evaluation: metrics of each row, over grouping sets, by bins, by rank, and temperatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx
from .ranks import ordinal

#: Bins of calibration errors, coverages of risk curves, and the range of temperatures.
BINS = 15
COVERAGES = (0.1, 0.25, 0.5, 0.75, 1.0)
COLDEST, HOTTEST = 0.05, 20.0


def row_metrics(df: DataFrame, p: str = "p", target: str = "target") -> DataFrame:
    """df with conf, correct (the top option has the target's greatest mass), acc (same first top option), nll, brier and kl."""
    a, t = F.col(p), F.col(target)
    return df.withColumns({"conf": F.array_max(a), "correct": ar.top1_correct(a, t).cast("double"), "acc": (ar.argmax(a) == ar.argmax(t)).cast("double"), "nll": ar.nll(a, t), "brier": ar.brier(a, t), "kl": ar.kl(t, a)})


def bin_of(conf: Column, bins: int = BINS) -> Column:
    """The bin (from 1) with the confidence in (lower, upper]; the first also has 0."""
    return F.greatest(F.ceil(conf * bins), F.lit(1))


def by_groups(df: DataFrame, groups: list[list[str]], correct: str = "correct", bins: int = BINS) -> DataFrame:
    """group_type, group_value, n, the mean metrics and ece for each grouping set. One pass: rows are first summed by bin within the finest keys."""
    named = sorted({c for g in groups for c in g})
    keyed = df.withColumn("bin_", bin_of(F.col("conf"), bins))
    sums = {m: F.sum(m).alias(m) for m in ("conf", correct, "nll", "brier", "kl")}
    fine = keyed.groupBy(*named, "bin_").agg(F.count("*").alias("n"), *sums.values())
    out = None
    for g in groups:  # over the few rows of sums
        cells = fine.groupBy(*g, "bin_").agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in sums))
        label = F.concat_ws("/", *(F.col(c).cast("string") for c in g)) if g else F.lit("all")
        means = [(F.sum(m) / F.sum("n")).alias({"conf": "mean_conf", correct: "acc"}.get(m, m)) for m in sums]
        one = cells.groupBy(*g).agg(F.sum("n").alias("n"), *means, (F.sum(F.abs(F.col("conf") - F.col(correct))) / F.sum("n")).alias("ece"))
        one = one.select(F.lit("+".join(g) or "all").alias("group_type"), label.alias("group_value"), "n", "acc", "nll", "brier", "kl", "mean_conf", "ece")
        out = one if out is None else out.unionByName(one)
    return out


def reliability(df: DataFrame, correct: str = "correct", bins: int = BINS) -> DataFrame:
    """For each bin that has rows: bin, n, mean_conf and mean_acc."""
    return df.groupBy(bin_of(F.col("conf"), bins).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg(correct).alias("mean_acc"))


def selective_risk(df: DataFrame, key: str = "id", correct: str = "correct", coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """For each coverage c: the error among the k = max(1, round half to even(c n)) most confident rows, ties by key."""
    ranked = ordinal(df.select("conf", key, correct), "r_", F.col("conf").desc(), key)
    n = ranked.count()
    ks = [(float(c), max(1, round(c * n))) for c in coverages]
    sums = ranked.agg(*(F.avg(F.when(F.col("r_") <= k, 1 - F.col(correct))).alias(f"c{i}") for i, (_, k) in enumerate(ks)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("coverage"), F.lit(k).cast("long").alias("k"), F.col(f"c{i}").alias("risk")) for i, (c, k) in enumerate(ks)))).alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """The correlation of ordinal ranks (ties by key); NaN for fewer than three rows or no variance."""
    ranked = ordinal(ordinal(df.select(a, b, key), "ra_", a, key), "rb_", b, key)
    r = F.corr(F.col("ra_").cast("double"), F.col("rb_").cast("double"))
    return ranked.agg(F.when((F.count("*") < 3) | (F.min(a) == F.max(a)) | (F.min(b) == F.max(b)), F.lit(float("nan"))).otherwise(r).alias("spearman"), F.count("*").alias("n"))


def score_mae(df: DataFrame, p: str = "p", target: str = "target", values: str = "option_values") -> DataFrame:
    """The mean absolute difference of expected values."""
    return df.agg(F.avg(F.abs(ar.expected(F.col(p), F.col(values)) - ar.expected(F.col(target), F.col(values)))).alias("mae"), F.count("*").alias("n"))


def temperature_grid(df: DataFrame, kind: str = "kind", grid: list[float] | None = None) -> DataFrame:
    """(kind, t, nll): the mean nll of each kind at each temperature of a short fixed grid."""
    grid = grid or [COLDEST * (HOTTEST / COLDEST) ** (i / 60) for i in range(61)]
    probed = df.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    return probed.groupBy(kind, "t").agg(F.avg(ar.nll(ar.softmax(F.col("logits"), F.col("t")), F.col("target"))).alias("nll"))


def fit_temperatures(df: DataFrame, kinds: list[str], rounds: int = 3) -> dict[str, float]:
    """The temperature of least nll for each kind, the grid refined around the best; 1.0 for a kind without rows. One job a round for all kinds."""
    ranges, out = dict.fromkeys(kinds, (COLDEST, HOTTEST)), dict.fromkeys(kinds, 1.0)
    for _ in range(rounds):
        grid = F.coalesce(*(F.when(F.col("kind") == k, F.array(*(F.lit(low * (high / low) ** (i / 24)) for i in range(25)))) for k, (low, high) in ranges.items()))
        probed = df.where(F.col("kind").isin(kinds)).withColumn("t", F.explode(grid))
        per = probed.groupBy("kind", "t").agg(F.avg(ar.nll(ar.softmax(F.col("logits"), F.col("t")), F.col("target"))).alias("nll"))
        for row in per.groupBy("kind").agg(F.min_by("t", F.struct("nll", "t")).alias("t")).collect():  # one a kind
            low, high = ranges[row["kind"]]
            step = (high / low) ** (1 / 24)
            out[row["kind"]] = row["t"]
            ranges[row["kind"]] = max(COLDEST, row["t"] / step), min(HOTTEST, row["t"] * step)
    return out


def prior(train: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """(keys, prior): the mean target of each key, place by place."""
    at = train.select(*keys, F.posexplode(target).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return at.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("prior"))


def pooled(results: DataFrame, by: list[str]) -> DataFrame:
    """Means weighted by n; mean_conf only if every row has it."""
    mean = lambda m: (F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(m)
    conf = F.when(F.bool_and(F.col("mean_conf").isNotNull()), F.sum(F.col("n") * F.col("mean_conf")) / F.sum("n")).alias("mean_conf")
    return results.groupBy(*by).agg(F.sum("n").alias("n"), mean("acc"), mean("nll"), mean("brier"), conf)


def gain(results: DataFrame, run: str, reference: str) -> DataFrame:
    """results with gain: points of accuracy over the reference run."""
    base = results.where(F.col(run) == reference).select(F.col("acc").alias("ref_"))
    return results.join(F.broadcast(base.limit(1)), how="cross").withColumn("gain", 100 * (F.col("acc") - F.col("ref_"))).drop("ref_")


#: Names under which external predictions may have true and false.
ALIASES = {"true": ("true", "yes", "1"), "false": ("false", "no", "0")}


def align_external(decisions: DataFrame, predictions: DataFrame) -> DataFrame:
    """decisions (id, keys) with p from predictions (id, probs map): by key, true and false also by their aliases; status names what is missing."""
    met = decisions.join(predictions, "id", "left")
    low = F.map_from_entries(F.transform(F.map_entries("probs"), lambda e: F.struct(F.when(F.lower(F.trim(e["key"])).isin(*(a for x in ALIASES.values() for a in x)), F.lower(F.trim(e["key"]))).otherwise(e["key"]).alias("key"), e["value"].alias("value"))))
    met = met.withColumn("m_", low)
    look = lambda k: F.coalesce(F.try_element_at("m_", k), *(F.when(k == name, F.try_element_at("m_", F.lit(a))) for name, all_ in ALIASES.items() for a in all_))
    met = met.withColumn("v_", F.transform("keys", look))
    bad = F.when(F.col("probs").isNull(), "no_prediction").when(F.exists("v_", lambda x: x.isNull()), "no_key").when(F.exists("v_", lambda x: x < 0) | (ar.total(F.col("v_")) <= 0), "bad_mass")
    return met.withColumn("status", F.coalesce(bad, F.lit("ok"))).withColumn("p", F.when(F.col("status") == "ok", ar.normalise(F.col("v_")))).drop("m_", "v_", "probs")


def split_by_seen(results: DataFrame, seen: DataFrame, source: str = "source") -> DataFrame:
    """Pooled means of the sources that an audit lists (seen) and of the others (not_flagged)."""
    listed = seen.select(F.col(source)).distinct().withColumn("listed_", F.lit(True))
    part = F.when(F.col("listed_"), "seen").otherwise("not_flagged")
    return pooled(results.join(listed, source, "left").withColumn("part", part), ["part"])


def evaluation_rows(rows: DataFrame, split: str, final: bool = False, limit: int | None = None, identity: str = "id", seed: int = 0) -> DataFrame:
    """The rows of a split, or a sample of ``limit`` of them by hash. The test split is refused without ``final``."""
    if split == "test" and not final:
        raise PermissionError("the test split is read only with final=True")
    of = rows.where(F.col("split") == split)
    return of if limit is None else of.orderBy(tx.uniform(F.col(identity).cast("string"), seed), identity).limit(limit)
