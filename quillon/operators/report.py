"""Reports: diversity of a mixture, counts, pivots, overlaps and statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import licenses


def effective_sources(df: DataFrame, key: str = "source") -> DataFrame:
    """exp of the entropy of sources' shares, the shares of the largest and the ten largest, and how many sources there are."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("total"), F.count("*").alias("sources"), F.count_if(F.col("n") >= 1000).alias("large"))
    top = per.orderBy(F.col("n").desc(), key).limit(10).agg(F.max("n").alias("top1"), F.sum("n").alias("top10"))
    share = F.col("n") / F.col("total")
    ent = per.join(F.broadcast(whole.select("total")), how="cross").agg((-F.sum(share * F.ln(share))).alias("h"))
    return whole.join(top, how="cross").join(ent, how="cross").select(F.exp("h").alias("effective_sources"), (F.col("top1") / F.col("total")).alias("top1_share"), (F.col("top10") / F.col("total")).alias("top10_share"), F.col("large").alias("sources_over_1000"), F.col("sources"))


def diversity(df: DataFrame) -> DataFrame:
    """Shares and means over decisions."""
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(F.count("*").alias("n"), share(F.size("options") == 2).alias("binary_share"), share(F.col("soft")).alias("soft_share"), F.avg(ar.entropy_bits(F.col("target"))).alias("entropy_bits"), F.avg(F.array_max("target")).alias("top_mass"), F.max(F.least(F.size("options"), F.lit(27))).cast("long").alias("most_options"))


def diversity_shares(df: DataFrame, fields: list[str], largest: int = 10, key: str = "source") -> DataFrame:
    """(field, value, n, share): the share of each value of each field, of each number of options up to 27, and of the ``largest`` sources, in one grouping-sets pass."""
    rows = df.withColumn("options_", F.least(F.size("options"), F.lit(27)).cast("string"))
    counts = counts_by(rows, [*fields, "options_", key]).withColumn("field", F.regexp_replace("field", "^options_$", "options"))
    total = counts.where("field = 'all'").select(F.col("n").alias("all_"))
    few = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    ranked = counts.where("field <> 'all'").withColumn("place", F.row_number().over(few)).where((F.col("field") != key) | (F.col("place") <= largest))
    return ranked.join(F.broadcast(total), how="cross").select("field", "value", "n", (F.col("n") / F.col("all_")).alias("share"))


def length_percentiles(df: DataFrame, text: str) -> DataFrame:
    p = F.percentile(F.length(text), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return df.agg(p.alias("p")).select(*(F.get("p", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """(field, value, n) for all rows and by each key, in one grouping-sets pass."""
    sets = df.groupingSets([[], *([k] for k in keys)], *keys).agg(F.count("*").alias("n"), *(F.grouping(k).alias(f"g_{k}") for k in keys))
    field = F.coalesce(*(F.when(F.col(f"g_{k}") == 0, F.lit(k)) for k in keys), F.lit("all"))
    value = F.coalesce(*(F.when(F.col(f"g_{k}") == 0, F.col(k).cast("string")) for k in keys), F.lit(""))
    return sets.select(field.alias("field"), value.alias("value"), "n")


def model_pivot(scores: DataFrame, models: list[str], benchmark: str = "benchmark", model: str = "model", score: str = "score") -> DataFrame:
    """A row for each benchmark, a column for each model."""
    return scores.groupBy(benchmark).pivot(model, models).agg(F.first(score))


def macro_mean(pivoted: DataFrame, models: list[str]) -> DataFrame:
    """Each model's mean over the benchmarks that all have."""
    shared = pivoted.dropna(subset=models)
    return shared.agg(F.count("*").alias("shared"), *(F.avg(f"`{m}`").alias(m) for m in models))


def status_lengths(df: DataFrame, by: str, status: str, length: str, bounds: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)) -> DataFrame:
    """Counts by group and status, and of rows over each length."""
    return df.groupBy(by, status).agg(F.count("*").alias("n"), *(F.count_if(F.col(length) > b).alias(f"over_{b}") for b in bounds))


def ledger(df: DataFrame, by: list[str], reason: str) -> DataFrame:
    """How many rows went for each reason."""
    return df.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("n"))


def area_summary(areas: DataFrame, runs: DataFrame, names: list[str], run: str = "run", area: str = "area") -> DataFrame:
    """A row for each run (run, index, raw_index): its indices, a column of skill for each area, and the mean coverage in percent (shares up to 1 are taken times 100) of the areas that have one."""
    skills = areas.groupBy(run).pivot(area, names).agg(F.first("skill"))
    mean = areas.groupBy(run).agg(F.avg("coverage").alias("c_"))
    out = runs.join(skills, run, "left").join(mean, run, "left")
    return out.withColumn("coverage", F.when(F.col("c_") <= 1, 100 * F.col("c_")).otherwise(F.col("c_"))).drop("c_")


def folder_index(pages: DataFrame, last: str = "Template") -> DataFrame:
    """(folder, type, place, entries): the pages (folder, type, title, path, status, description) of each folder by type as lines of a list; pages without a type are Other, and ``last`` comes after the others."""
    kind = F.coalesce("type", F.lit("Other"))
    line = F.concat(F.lit("* ["), "title", F.lit("](/"), "path", F.lit(") - "), F.coalesce(F.concat(F.lit("["), "status", F.lit("] ")), F.lit("")), F.coalesce("description", F.lit("")))
    grouped = pages.select("folder", kind.alias("type"), "path", line.alias("line")).groupBy("folder", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda s: s["line"]).alias("entries"))
    order = Window.partitionBy("folder").orderBy(F.col("type") == last, "type")
    return grouped.withColumn("place", F.row_number().over(order).cast("long"))


def newly_admitted(df: DataFrame, by: list[str], licence: str = "license") -> DataFrame:
    """(by, n): the rows whose licence passes only without its annotations."""
    plain, bare = (licenses.allowed(licenses.reason(F.col(licence), strip_annotations=s)) for s in (False, True))
    return df.where(bare & ~plain).groupBy(*by).agg(F.count("*").alias("n"))
