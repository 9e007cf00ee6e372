"""Leak guards: what evaluation rows hold is not trained on.

An index holds the evaluation states' hashes, their groups, and the fingerprints of their distinct states with the
number of states and the source (or that there are several). Training rows are flagged by joins; each row gets its
first reason in a fixed order, so the ledger of drops adds up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Fixed value: a fingerprint in more evaluation states than this is boilerplate.
BOILERPLATE = 3


@dataclass
class GuardIndex:
    states: DataFrame  # h
    groups: DataFrame  # g
    prints: DataFrame  # fp, df, src_min, src_max


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over all cores where they come from fewer files than there are cores; else as they are. Work in Python would otherwise be left to a few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if not rows.isStreaming and 0 < len(rows.inputFiles()) < cores else rows


def fingerprinted(rows: DataFrame, state: str, hex_prints: bool = False, **more: Column) -> DataFrame:
    """(more columns, h_, size_, fps_): the hash, the normal form's length and the fingerprints of each row's state, by one pass that carries nothing else."""
    narrow = spread(rows.select(F.col(state).alias("state_"), *(c.alias(k) for k, c in more.items())))
    return narrow.select(*more, tx.prepared(F.col("state_"), hex_prints).alias("p_")).select(*more, F.col("p_.h").alias("h_"), F.col("p_.size").alias("size_"), F.col("p_.fps").alias("fps_"))


def build_index(evaluation: DataFrame, state: str = "state", group: str = "group_id", source: str = "source", order: Column | None = None, hex_prints: bool = False) -> GuardIndex:
    """The index of evaluation rows. A repeated state is attributed to the source of its first row."""
    hashed = fingerprinted(evaluation, state, hex_prints, src=F.col(source), o_=order if order is not None else F.col(source))
    once = hashed.groupBy("h_").agg(F.min_by(F.struct("src", "fps_"), "o_").alias("x"))
    exploded = once.select(F.col("x.src").alias("src"), F.explode_outer("x.fps_").alias("fp")).where("fp is not null")  # outer: an inner one filters on the arrays, building them once more for each gram
    return GuardIndex(
        once.select(F.col("h_").alias("h")),
        evaluation.where(F.col(group).isNotNull()).select(F.col(group).alias("g")).distinct(),
        exploded.groupBy("fp").agg(F.count("*").alias("df"), F.min("src").alias("src_min"), F.max("src").alias("src_max")),
    )


def print_hits(rows: DataFrame, index: GuardIndex, key: str, state: str = "state", group: str | None = None, source: str | None = "source", boilerplate: int | None = BOILERPLATE, hex_prints: bool = False) -> DataFrame:
    """(key, h, size, in_states, in_groups, hits, n_fps), a row a key: the hash and length of its state's normal form, whether the index has its state and its group, and how many of its fingerprints evaluation states of other sources have (of any, if source is None).

    States are hashed and fingerprinted in one pass, and one exchange by key counts what the prints meet; rows that the index has whole aren't looked up by print.
    """
    keep = index.prints if boilerplate is None else index.prints.where(F.col("df") <= boilerplate)
    null = F.lit(None).cast("string")
    f = fingerprinted(rows, state, hex_prints, k_=F.col(key), g_=F.col(group) if group else null, mine_=F.col(source) if source else null)
    f = f.join(index.states.select(F.col("h").alias("h_"), F.lit(True).alias("in_states")), "h_", "left")
    f = f.join(index.groups.select(F.col("g").alias("g_"), F.lit(True).alias("in_groups")), "g_", "left") if group else f.withColumn("in_groups", F.lit(False))
    known = F.coalesce("in_states", F.lit(False)) | F.coalesce("in_groups", F.lit(False))
    looked = F.when(~known, F.col("fps_")) if group else F.col("fps_")
    f = f.select("k_", "h_", "size_", "mine_", "in_states", "in_groups", F.size("fps_").alias("n_"), F.explode_outer(looked).alias("fp"))
    other = F.col("mine_").isNull() | (F.col("src_min") != F.col("mine_")) | (F.col("src_max") != F.col("mine_"))
    met = f.join(keep, "fp", "left").groupBy("k_").agg(F.min("h_").alias("h"), F.min("size_").alias("size"), F.coalesce(F.max("in_states"), F.lit(False)).alias("in_states"), F.coalesce(F.max("in_groups"), F.lit(False)).alias("in_groups"), F.count_if(F.col("df").isNotNull() & other).alias("hits"), F.max("n_").alias("n_fps"))
    return met.withColumnRenamed("k_", key)


def is_leak(hits: Column, n_fps: Column) -> Column:
    """Two shared fingerprints, or one of a row that has two at most."""
    return (hits >= 2) | ((hits >= 1) & (n_fps <= 2))


def first_leak() -> Column:
    """The first leak that ``print_hits`` shows, or null."""
    return F.when(F.col("in_states"), "leak_state").when(F.col("in_groups"), "leak_group").when(is_leak(F.col("hits"), F.col("n_fps")), "leak_ngram")


def flag_leaks(rows: DataFrame, index: GuardIndex, key: str = "id", state: str = "state", group: str = "group_id", source: str | None = "source", boilerplate: int | None = BOILERPLATE, hex_prints: bool = False) -> DataFrame:
    """rows with leak: leak_state, leak_group, leak_ngram (the first that holds) or null. Keys tell rows apart; only the flagged keys meet the rows again."""
    found = print_hits(rows, index, key, state, group, source, boilerplate, hex_prints).select(F.col(key).alias("k_"), first_leak().alias("leak")).where("leak is not null")
    return rows.join(found, F.col(key).eqNullSafe(F.col("k_")), "left").select(*rows.columns, "leak")


def keep_first(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("k_", key).withColumn("n_", F.row_number().over(Window.partitionBy("k_").orderBy(order))).where("n_ = 1").drop("k_", "n_")


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row that two tables share if and only if they hold the same rows, in any order: count and the sums of two row hashes."""
    h = F.sha2(F.to_json(F.struct(*columns)), 256)
    number = lambda a: F.conv(F.substring(h, a, 12), 16, 10).cast("decimal(20,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(number(1)).alias("a"), F.sum(number(13)).alias("b"))


def assert_disjoint(left: DataFrame, right: DataFrame, on: str) -> None:
    if not left.select(on).join(right.select(on), on, "left_semi").isEmpty():
        raise AssertionError(f"rows meet on {on}")


def assert_nested(small: DataFrame, large: DataFrame, on: str) -> None:
    if not small.select(on).exceptAll(large.select(on)).isEmpty():
        raise AssertionError(f"not nested on {on}")


def leak_filter(candidates: DataFrame, states: DataFrame, key: str = "id", state: str = "state", boilerplate: int = BOILERPLATE, hex_prints: bool = False) -> DataFrame:
    """candidates with leak: leak_state_in_train, leak_ngram_in_train or null, against the states of a training table.

    Here the candidates' side says what is boilerplate: a fingerprint that more than ``boilerplate`` distinct candidate
    states have that aren't training states themselves.
    """
    trained = fingerprinted(states, state, hex_prints)
    known = trained.select("h_", F.lit(True).alias("known_")).distinct()
    own = fingerprinted(candidates, state, hex_prints, k_=F.col(key)).join(known, "h_", "left")
    theirs = trained.select(F.explode_outer("fps_").alias("fp")).where("fp is not null").distinct().withColumn("met_", F.lit(True))
    prints = own.select("k_", "h_", "known_", F.size("fps_").alias("n_"), F.explode_outer(F.when(F.col("known_").isNull(), F.col("fps_"))).alias("fp"))
    met = prints.join(theirs, "fp", "left")
    rare = met.where("met_").groupBy("fp").agg(F.count_distinct("h_").alias("df")).where(F.col("df") <= boilerplate).select(F.col("fp").alias("rare_"))
    hits = met.join(rare, F.col("fp") == F.col("rare_"), "left").groupBy("k_").agg(F.max("known_").alias("known_"), F.count("rare_").alias("hits"), F.max("n_").alias("n_"))
    leak = F.when(F.col("known_"), "leak_state_in_train").when(is_leak(F.col("hits"), F.col("n_")), "leak_ngram_in_train")
    found = hits.select("k_", leak.alias("leak")).where("leak is not null")
    return candidates.join(found, F.col(key).eqNullSafe(F.col("k_")), "left").select(*candidates.columns, "leak")
