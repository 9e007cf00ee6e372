"""Label novelty and name overlap: which sources ask what training has not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Thresholds of eligibility.
THRESHOLDS = {"min_train": 100, "min_eval": 150, "min_repeat": 20, "repeat": 0.5, "seen": 0.1, "overlap": 0.3}
#: Task families known by name.
FAMILY_TASKS = (
    "mnli", "snli", "anli", "rte", "boolq", "sst", "ag_news", "agnews", "imdb", "qnli", "wnli", "cola", "mrpc", "qqp", "squad", "arc",
    "commonsense_qa", "hellaswag", "winogrande", "piqa", "copa", "multirc", "record", "wic", "wsc", "cb", "trec", "yelp", "amazon_polarity",
    "emotion", "go_emotions", "banking77", "clinc", "civil_comments", "toxic", "aqua_rat", "gsm8k", "math", "drop", "quail",
)


def option_set(options: Column, normal=tx.norm_text_simple) -> Column:
    """A canonical key of a set of options."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(options, normal))), "\x1f")


def set_stats(df: DataFrame, source: str = "source", options: str = "options", split: str = "split") -> DataFrame:
    """(source, set, n, n_train, k): how often each source has each option set, and its options."""
    keyed = df.withColumn("set", option_set(F.col(options)))
    return keyed.groupBy(source, "set").agg(F.count("*").alias("n"), F.count_if(F.col(split) == "train").alias("n_train"), F.max(F.size(options)).cast("long").alias("k"))


def source_scores(stats: DataFrame, min_repeat: int = 20) -> DataFrame:
    """For each source: n, n_train, n_eval, sets, repeat_fraction (rows whose set is common in it), seen_fraction (rows whose set another source trains on) and string_overlap (distinct options that another source trains on)."""
    per = Window.partitionBy("set")
    trains = F.sum((F.col("n_train") > 0).cast("long")).over(per)
    seen = stats.withColumn("others", trains - (F.col("n_train") > 0).cast("long") > 0)
    rows = seen.groupBy("source").agg(
        F.sum("n").alias("n"), F.sum("n_train").alias("n_train"), F.sum(F.col("n") - F.col("n_train")).alias("n_eval"), F.count("*").alias("sets"),
        (F.sum(F.when(F.col("n") >= min_repeat, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeat_fraction"), (F.sum(F.when(F.col("others"), F.col("n")).otherwise(0)) / F.sum("n")).alias("seen_fraction"),
    )
    strings = stats.select("source", F.explode(F.split("set", "\x1f")).alias("s"), F.col("n_train")).groupBy("source", "s").agg((F.max("n_train") > 0).alias("t"))
    used = F.sum(F.col("t").cast("long")).over(Window.partitionBy("s")) - F.col("t").cast("long") > 0
    overlap = strings.withColumn("others", used).groupBy("source").agg(F.avg(F.col("others").cast("double")).alias("string_overlap"))
    return rows.join(overlap, "source")


def ineligible(t: dict | None = None) -> Column:
    """Why a source is not eligible, by the first rule; null if it is."""
    t = THRESHOLDS | (t or {})
    rules = ((F.col("n_train") < t["min_train"], "n_train"), (F.col("n_eval") < t["min_eval"], "n_eval"), (F.col("repeat_fraction") < t["repeat"], "repeat_fraction"), (F.col("seen_fraction") > t["seen"], "seen_fraction"), (F.col("string_overlap") > t["overlap"], "string_overlap"))
    return F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in rules))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The upper median, by rank, of each group."""
    n = F.count("*").over(Window.partitionBy(*by))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1
    return df.select(*by, value, n.alias("n_"), r.alias("r_")).where(F.col("r_") == F.floor(F.col("n_") / 2)).select(*by, F.col(value).alias("median"))


def familiar(candidates: DataFrame, trained: DataFrame) -> DataFrame:
    """candidates (name) with familiar: the least trained name that has an equal part, or of five characters or more one that contains the other.

    Equal parts meet by an equi-join; containment meets through the parts' 5-grams, so no pair is formed that shares none.
    """
    parts = lambda df, name: df.select(F.col(name), F.explode(tx.squash(F.col(name))).alias("p")).distinct()
    a, b = parts(candidates.select("name"), "name"), parts(trained.select(F.col("name").alias("trained")), "trained").withColumnRenamed("p", "q")
    same = a.join(b, F.col("p") == F.col("q")).select("name", "trained")
    five = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 4), lambda i: F.substring(c, i, F.lit(5))))
    ga = a.where("length(p) >= 5").withColumn("g", F.explode(five(F.col("p"))))
    gb = b.where("length(q) >= 5").withColumn("g", F.explode(five(F.col("q"))))
    inside = ga.join(gb, "g").where(F.contains("p", "q") | F.contains("q", "p")).select("name", "trained")
    found = same.union(inside).groupBy("name").agg(F.min("trained").alias("familiar"))
    return candidates.join(found, "name", "left")


def _cores(prefixes: DataFrame, lead: str | None) -> DataFrame:
    """(prefix, core): normal names without what the pattern lead matches at their start, of four characters at least."""
    name = tx.name_norm(F.col("prefix"))
    return prefixes.select("prefix", (F.regexp_replace(name, f"^(?:{lead})", "") if lead else name).alias("core")).where("length(core) >= 4")


def audit_names(sources: DataFrame, prefixes: DataFrame, lead: str | None = None) -> DataFrame:
    """(source, reasons): policy prefixes (a short given list) whose core stands in the source's token or has it, and task families by name; ``policy_overlap`` has the policy's further rules."""
    s = sources.select("source", tx.task_token(F.col("source")).alias("token"))
    hit = F.contains("token", "core") | ((F.length("token") >= 4) & F.contains("core", "token"))
    named = s.join(F.broadcast(_cores(prefixes, lead)), hit).select("source", F.concat(F.lit("name:"), "prefix").alias("reason"))
    tasks = F.filter(F.array(*map(F.lit, FAMILY_TASKS)), lambda t: (F.col("token") == t) | F.startswith(F.col("token"), F.concat(t, F.lit("_"))) | F.endswith(F.col("token"), F.concat(F.lit("_"), t)))
    families = s.select("source", F.explode(tasks).alias("t")).select("source", F.concat(F.lit("family:"), "t").alias("reason"))
    return named.union(families).groupBy("source").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def derive(train: DataFrame, validation: DataFrame, heldout: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, heldout) with the sources' rows taken from training and moved from validation to the held-out set."""
    out = F.col("source").isin(sources)
    return train.where(~out), validation.where(~out), heldout.unionByName(validation.where(out), allowMissingColumns=True)


#: Prefixes are held against every source, by a broadcast of them: so many at most.
MOST_PREFIXES = 5000


def policy_overlap(sources: DataFrame, prefixes: list[str], collections: dict[str, list[str]] | None = None, families: list[str] | None = None, hub: str | None = None, hub_prefix: str | None = None, lead: str | None = None) -> DataFrame:
    """(source, reasons) of the sources (source, dataset) that a policy's prefixes cover.

    name: a prefix's core in the source's token, or the other way round; a core is a prefix's normal name without what the
    pattern ``lead`` matches at its start, of four characters at least. collection: a prefix named for the source's
    dataset. family: for a source of a well-known task, the first two family prefixes of the policy. alias: a source
    without any of these whose collection or dataset is a path component of a source of the hub, a collection that
    repackages others. The policy's lists are configuration of a few hundred entries.
    """
    s = sources.select("source", "dataset", tx.task_token(F.col("source")).alias("token"))
    if len(prefixes) > MOST_PREFIXES:
        raise ValueError(f"a policy has {len(prefixes)} prefixes; each is held against every source, so {MOST_PREFIXES} are the most")
    cores = sources.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    cores = _cores(cores, lead)
    hit = F.contains("token", "core") | ((F.length("token") >= 4) & F.contains("core", "token"))
    found = s.join(F.broadcast(cores), hit).select("source", F.concat(F.lit("name:"), "prefix").alias("reason"))
    given = [(c, p) for c, some in (collections or {}).items() for p in some if p in prefixes]
    if given:
        rules = sources.sparkSession.createDataFrame(given, "dataset string, prefix string")
        found = found.union(s.join(F.broadcast(rules), "dataset").select("source", F.concat(F.lit("collection:"), "prefix")))
    if own := [p for p in families or [] if p in prefixes][:2]:
        known = F.exists(F.array(*map(F.lit, FAMILY_TASKS)), lambda t: (F.col("token") == t) | F.startswith(F.col("token"), F.concat(t, F.lit("_"))) | F.endswith(F.col("token"), F.concat(F.lit("_"), t)))
        found = found.union(s.where(known).select("source", F.explode(F.array(*(F.lit(f"family:{p}") for p in own)))))
    listed = found.groupBy("source").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    if hub is None or hub_prefix not in prefixes:
        return listed
    parts = s.where(F.col("dataset") == hub).select(F.explode(F.slice(F.split("source", "/", -1), 2, 1 << 20)).alias("p")).select(tx.name_norm(F.col("p")).alias("p")).distinct()
    rest = s.where(F.col("dataset") != hub).join(listed, "source", "left_anti")
    names = rest.select("source", F.explode(F.array(tx.name_norm(F.substring_index("source", "/", 1)), tx.name_norm(F.col("dataset")))).alias("p"))
    alias = names.join(parts, "p").groupBy("source").agg(F.min("p").alias("p"))
    return listed.union(alias.select("source", F.array(F.concat(F.lit(f"alias:{hub} contains '"), "p", F.lit("'")))))


def flagged_by_collection(sources: DataFrame, matches: DataFrame) -> DataFrame:
    """(dataset, sources, flagged): how many sources each collection has, and how many of them an audit lists."""
    marked = sources.join(matches.select("source", F.lit(True).alias("listed_")), "source", "left")
    return marked.groupBy("dataset").agg(F.count("*").alias("sources"), F.count_if("listed_").alias("flagged"))


def label_summary(df: DataFrame, source: str = "source", most: int = 8) -> DataFrame:
    """For each source: its most common kind, its upper median of options a row, and the first strings of its most common option set. Ties go to the lesser value."""
    keyed = df.select(F.col(source), "kind", F.size(F.array_distinct("options")).alias("k_"), option_set(F.col("options")).alias("set_"))
    top = lambda value: F.max_by(value, F.struct("n", F.col("r_")))

    def commonest(value: str) -> DataFrame:
        counts = keyed.groupBy(source, value).agg(F.count("*").alias("n"))
        ranked = counts.withColumn("r_", F.row_number().over(Window.partitionBy(source).orderBy(F.col(value).desc())))  # distinct values of a source
        return ranked.groupBy(source).agg(top(value).alias(value))

    sizes = keyed.groupBy(source, "k_").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(source).orderBy("k_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = F.sum("n").over(Window.partitionBy(source))
    median = sizes.select(source, "k_", upto.alias("upto"), all_.alias("all")).where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(source).agg(F.min("k_").cast("long").alias("median_options"))
    sets = commonest("set_").select(source, F.slice(F.split("set_", "\x1f", -1), 1, most).alias("label_set"))
    return commonest("kind").join(median, source).join(sets, source)
