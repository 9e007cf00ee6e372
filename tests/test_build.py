"""Ranks over partitions, exclusions, the test gate, the additional evaluation build and its leak filter."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import extra_eval, guard, metrics, mixture, novelty, ranks, sampling


def test_ordinal_is_the_row_number(spark):
    df = spark.range(5000).select("id", (F.xxhash64("id") % 7).alias("v")).repartition(9)
    got = ranks.ordinal(df, "r", F.col("v").desc(), "id").collect()
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert sorted((r["r"], r["v"], r["id"]) for r in got) == [(i + 1, v, k) for i, (v, k) in enumerate(want)]
    assert ranks.ordinal(df.limit(0), "r", "id").count() == 0


def test_spearman_of_few_or_equal_values_is_nan(spark):
    rows = spark.createDataFrame([(i, float(i), 1.0) for i in range(5)], "id long, a double, b double")
    assert str(metrics.spearman(rows, "a", "b", "id").first()["spearman"]) == "nan"
    assert metrics.spearman(rows.withColumn("b", -F.col("a")), "a", "b", "id").first()["spearman"] == pytest.approx(-1)


def test_weighted_top_does_not_depend_on_salts(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("source"))
    quota = spark.createDataFrame([("hot", 40), ("cold", 7)], "source string, quota int")
    one, many = ({r["id"] for r in sampling.weighted_top(df, quota, F.lit(1.0), salts=s).collect()} for s in (1, 16))
    assert one == many and len(one) == 47


def test_exclusions_are_sorted_and_distinct():
    assert mixture.exclusions({"exclude_sources": ["b/*", "a"]}, [{"held_out_sources": ["c", "a"]}, {"task_novel_sources": ["d"], "exclude_sources": None}]) == ["a", "b/*", "c", "d"]
    assert mixture.exclusions({}) == []


def test_the_test_split_needs_final(spark):
    rows = spark.createDataFrame([(i, "test" if i % 2 else "validation") for i in range(20)], "id long, split string")
    with pytest.raises(PermissionError):
        metrics.evaluation_rows(rows, "test")
    assert metrics.evaluation_rows(rows, "test", final=True).count() == 10
    assert metrics.evaluation_rows(rows, "validation", limit=3).count() == 3


def words(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_leak_filter_tells_boilerplate_by_the_candidates(spark):
    shared, template = words("s", 90), words("t", 90)
    rows = [("a", words("k")), ("b", "own " + shared + " text"), *((f"t{i}", f"{words(f'x{i}_')} {template}") for i in range(4)), ("c", words("y"))]
    train = [(words("K").upper(),), ("another " + shared,), (template,)]
    out = guard.leak_filter(spark.createDataFrame(rows, "id string, state string"), spark.createDataFrame(train, "state string"))
    assert {r["id"]: r["leak"] for r in out.collect()} == {"a": "leak_state_in_train", "b": "leak_ngram_in_train", "t0": None, "t1": None, "t2": None, "t3": None, "c": None}


def decision(i, source, options, **more):
    return {"id": str(i), "source": source, "split": "test", "license": "mit", "kind": "choice", "state": words(f"{source}{i}_", 30), "question": "q", "options": options, "target": [1.0, 0.0], "option_values": None} | more


def test_extra_eval_keeps_novel_sources(spark):
    schema = "id string, source string, split string, license string, kind string, state string, question string, options array<string>, target array<double>, option_values array<double>"
    rows = [decision(i, "new/one", ["red", "blue"]) for i in range(30)]
    rows += [decision(100 + i, "new/seen", ["Yes", "no"]) for i in range(30)]
    rows += [decision(200 + i, "new/items", [f"a{i}", f"b{i}"]) for i in range(30)]
    rows += [decision(300 + i, "old/x", ["red", "blue"]) for i in range(5)]
    rows += [decision(400, "new/one", ["red", "blue"], license="cc-by-nc-4.0"), decision(401, "new/one", ["red"]), decision(402, "new/one", ["red", "blue"], state="z" * 20000)]
    trained = spark.createDataFrame([("old/x", "a state", ["yes", "No"])], "source string, state string, options array<string>")
    out = extra_eval.build(spark.createDataFrame(rows, schema), trained, extra_eval.Settings(min_eval=10, per_source=20, min_repeat=10))
    assert {r["source"]: (r["n_rows"], r["rejected"]) for r in out["sources"].collect()} == {"new/one": (20, None), "new/seen": (20, "seen_fraction"), "new/items": (20, "repeat_fraction")}
    assert {r["reason"]: r["n"] for r in out["drops"].collect()} == {"source_in_training_mixture": 5, "licence:non_commercial": 1, "invalid_or_too_long": 2}
    assert {r["source"] for r in out["rows"].collect()} == {"new/one"} and out["rows"].count() == 20


def test_aliases_of_the_hub(spark):
    s = spark.createDataFrame([("hub/Steer-2/en", "hub"), ("steer_2/x", "c"), ("other/x", "c")], "source string, dataset string")
    got = {r["source"]: r["reasons"] for r in novelty.policy_overlap(s, ["hub__"], hub="hub", hub_prefix="hub__").collect()}
    assert got == {"steer_2/x": ["alias:hub contains 'steer_2'"]}
    assert novelty.policy_overlap(s, ["else__"], hub="hub", hub_prefix="hub__").count() == 0
