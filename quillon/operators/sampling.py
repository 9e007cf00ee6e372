"""Sampling: limits, samples, quotas and weighted selection, all by hash priorities, so repartitioning changes nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ranks import ordinal


def first_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("n_") <= n).drop("n_")


def nth(df: DataFrame, key: str, order: str, n: int, salts: int = 16) -> DataFrame:
    """(key, order): the n-th least value of each key that has so many. Keys are cut to n in each of several salts first, so no task sorts a large key whole."""
    rows = df.select(key, order).withColumn("salt_", F.pmod(F.xxhash64(order), F.lit(salts)))
    for by in ((key, "salt_"), (key,)):
        rows = rows.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("n_") <= n)
    return rows.where(F.col("n_") == n).select(key, order)


def bottom_k(df: DataFrame, key: str, identity: str, k: int, seed: int = 0, salts: int = 16) -> DataFrame:
    """A uniform sample of at most k rows of each key, nested in k. A key's rows are first cut to k in each of several salts, so no task gets a large key whole."""
    u = tx.uniform(F.col(identity).cast("string"), seed)
    df = df.withColumn("u_", u).withColumn("salt_", F.pmod(F.xxhash64(identity), F.lit(salts)))
    part = Window.partitionBy(key, "salt_").orderBy("u_", identity)
    df = df.withColumn("n_", F.row_number().over(part)).where(F.col("n_") <= k)
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy("u_", identity))).where(F.col("n_") <= k).drop("u_", "n_", "salt_")


def quotas(counts: DataFrame, total: float, alpha: float = 0.5, cap: float | None = None, key: str = "source", n: str = "n") -> DataFrame:
    """counts with quota: floor(min(n, cap, c n^alpha)) with c such that they add up to total.

    In closed form: ordered by the c at which a source saturates, c is what is left of the total after the saturated
    ones, over the others' n^alpha, at the first source that c leaves open.
    """
    b = F.col(n).cast("double") if cap is None else F.least(F.col(n).cast("double"), F.lit(float(cap)))
    df = counts.withColumn("b_", b).withColumn("w_", F.pow(F.col(n).cast("double"), F.lit(alpha))).withColumn("t_", F.col("b_") / F.col("w_"))
    order = Window.orderBy("t_", key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("c_", (F.lit(float(total)) - F.coalesce(F.sum("b_").over(before), F.lit(0.0))) / F.sum("w_").over(rest))
    everything = Window.partitionBy()
    c = F.min_by(F.when(F.col("c_") < F.col("t_"), F.col("c_")), F.when(F.col("c_") < F.col("t_"), F.struct("t_", key))).over(everything)
    df = df.withColumn("c", c).withColumn("all_", F.sum("b_").over(everything))
    open_ = (F.col("all_") > total) & F.col("c").isNotNull() & (F.col("t_") > F.col("c"))
    return df.withColumn("quota", F.when(open_, F.greatest(F.lit(0.0), F.floor(F.col("c") * F.col("w_") - 1e-9))).otherwise(F.floor("b_")).cast("long")).drop("b_", "w_", "t_", "c_", "c", "all_")


def family(source: Column, dataset: Column, patterns: dict[str, str]) -> Column:
    """The first family (name: pattern) whose pattern the source matches, or its dataset."""
    return F.coalesce(*(F.when(source.rlike(tx.glob_regex([p])), F.lit(name)) for name, p in patterns.items()), dataset)


def weighted_top(df: DataFrame, quota: DataFrame, weight: Column, key: str = "source", identity: str = "id", seed: int = 0, salts: int = 16, place: str | None = None) -> DataFrame:
    """A weighted sample without replacement of quota rows of each key: the greatest ln(u) / weight; place names a column for the rank. A key's rows are first cut to its quota in each of several salts, so no task gets a large key whole."""
    u = (F.floor(tx.uniform(F.col(identity).cast("string"), seed) * F.lit(float(1 << 52))) + 0.5) / F.lit(float(1 << 52))
    ranked = df.join(quota.select(key, "quota"), key).withColumn("key_", F.ln(u) / weight)
    ranked = ranked.withColumn("salt_", F.pmod(F.xxhash64(identity), F.lit(salts)))
    for by in ((key, "salt_"), (key,)):
        ranked = ranked.withColumn("n_", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("key_").desc(), identity))).where(F.col("n_") <= F.col("quota"))
    return (ranked.withColumnRenamed("n_", place) if place else ranked.drop("n_")).drop("key_", "quota", "salt_")


def most_common(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """(by, value, n, place): the k most common values of each group, ties to the lesser value; one row a value is ranked."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), value)).cast("long")).where(F.col("place") <= k)


def missing(wanted: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """The distinct keys of one table that another lacks."""
    return wanted.select(key).distinct().join(given.select(key), key, "left_anti")


def row_weight(boosts: dict[str, float], binary_penalty: float = 1.0) -> Column:
    """A kind's boost, times the penalty for two options of other kinds than noul."""
    boost = reduce(lambda c, kv: F.when(F.col("kind") == kv[0], F.lit(float(kv[1]))).otherwise(c), boosts.items(), F.lit(1.0))
    return boost * F.when((F.size("options") == 2) & (F.col("kind") != "noul"), F.lit(float(binary_penalty))).otherwise(1.0)


def composition(df: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), *(share(F.col("kind") == k).alias(k) for k in ("noul", "score", "choice")), share(F.size("options") == 2).alias("binary"))


def split_by(group: Column, share: float, seed: int) -> Column:
    """Whether a group falls in the share."""
    return tx.uniform(group, seed) < share


def stratified_pick(df: DataFrame, stratum: str, identity: str, n: int, seed: int = 0) -> DataFrame:
    """One row of each stratum in turn, in hash order, until there are n."""
    ranked = df.withColumn("u_", tx.uniform(F.col(identity).cast("string"), seed))
    ranked = ranked.withColumn("n_", F.row_number().over(Window.partitionBy(stratum).orderBy("u_", identity)))
    return ranked.where(F.col("n_") <= n).orderBy("n_", stratum).limit(n).drop("u_", "n_")


def length_batches(df: DataFrame, identity: str, size: Column, batch: int, seed: int = 0, mega: int = 50, skip: int = 0) -> DataFrame:
    """df with batch_order (from 0) and place: rows shuffled, cut into chunks of mega batches, sorted by size inside a chunk, the batches shuffled.

    The shuffle is by hash: rows fall into hash ranges of about one chunk, so no order over all rows is needed; a range's
    last batch may be short. Batches before ``skip`` are left out, for resuming.
    """
    rows = df.count()
    chunks = max(1, -(-rows // (mega * batch)))
    u = tx.uniform(F.col(identity).cast("string"), seed)
    df = df.withColumn("chunk_", F.floor(u * chunks)).withColumn("size_", size)
    df = df.withColumn("r_", F.row_number().over(Window.partitionBy("chunk_").orderBy("size_", identity)) - 1)
    df = df.withColumn("batch_", F.floor(F.col("r_") / batch)).withColumn("place", (F.col("r_") % batch).cast("long"))
    heads = df.select("chunk_", "batch_").distinct().withColumn("h_", tx.uniform(F.concat_ws(":", "chunk_", "batch_"), seed + 1))
    heads = ordinal(heads, "batch_order", "h_", "chunk_", "batch_").withColumn("batch_order", (F.col("batch_order") - 1).cast("long"))
    return df.join(heads, ["chunk_", "batch_"]).where(F.col("batch_order") >= skip).drop("chunk_", "batch_", "size_", "r_", "h_")
