"""Mixtures with caps, floors, two-option caps and named sizes."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.operators import mixture, sampling, selection

KINDS = [("A/big", 600, "choice", "abc"), ("A/bin", 400, "choice", "xy"), ("A/noul", 300, "noul", "yn"), ("A/score", 300, "score", "01234"), ("proc/p1", 300, "choice", "abcd"), ("proc/p2", 300, "choice", "abcd")]
ASKED = dict(total=1200, max_source_share=0.3, families={"procedural": "proc/*"}, family_caps={"procedural": 0.15}, kind_floors={"noul": 0.10, "score": 0.10}, max_binary=0.5, sizes={"small": 400, "mid": 800, "huge": 5000})


def pool(spark, kinds=KINDS):
    rows = [(f"{s}:{i}", s, "A", k, list(o)) for s, n, k, o in kinds for i in range(n)]
    return spark.createDataFrame(rows, "id string, source string, dataset string, kind string, options array<string>")


def test_sizes_are_nested_and_caps_and_floors_hold(spark):
    selected, quota, solved = selection.mixture(pool(spark), selection.Sizes(**ASKED))
    rows = selected.collect()
    full = {r["id"] for r in rows}
    mid, small = ({r["id"] for r in rows if x in r["sizes"]} for x in ("mid", "small"))
    assert small < mid < full and not any("huge" in r["sizes"] for r in rows)
    assert 1190 <= len(full) <= 1200 and 790 <= len(mid) <= 800 and 390 <= len(small) <= 400
    assert sum(r["source"].startswith("proc/") for r in rows) <= 180 and solved.converged
    per = quota.collect()
    assert max(q["quota"] for q in per) <= 360 and sum(q["quota"] for q in per if q["family"] == "procedural") in (178, 179, 180)
    for some in (rows, [r for r in rows if "mid" in r["sizes"]]):
        assert all(sum(r["kind"] == k for r in some) >= 0.07 * len(some) for k in ("noul", "score"))
    again = selection.mixture(pool(spark).repartition(5), selection.Sizes(**ASKED))[0]
    assert {r["id"] for r in again.collect()} == full


def test_an_infeasible_floor_is_reported(spark):
    few = pool(spark, [("A/c", 500, "choice", "abc"), ("A/n", 10, "noul", "yn")])
    _, _, solved = selection.mixture(few, selection.Sizes(total=400, kind_floors={"noul": 0.5}))
    assert not solved.converged and solved.boosts["noul"] == pytest.approx(200.0) and solved.composition["noul"] < 0.05


def test_met_targets_move_nothing_and_levers_come_back():
    assert selection._moved(1.0, 0.1, 0.3, 1.0, selection.BOOST) == 1.0 and selection._moved(1.0, 0.5, 0.2, 1.0, selection.PENALTY) == 1.0
    assert 1.0 <= selection._moved(4.0, 0.1, 0.3, 1.0, selection.BOOST) < 4.0 and 0.1 < selection._moved(0.1, 0.5, 0.2, 1.0, selection.PENALTY) <= 1.0
    assert selection._moved(4.0, 0.1, 0.103, 1.0, selection.BOOST) == 4.0
    assert selection._moved(1.0, 0.4, 0.2, 1.0, selection.BOOST) == pytest.approx(2**0.8)


def test_summaries_give_the_composition_of_the_selection(spark):
    rows = pool(spark)
    quota = selection.all_quotas(rows, selection.Sizes(**ASKED))
    summary = selection.summaries(rows, quota, 3)
    for boosts, penalty in (({}, 1.0), ({"noul": 3.0, "score": 1.7}, 0.4)):
        got = selection.composed(summary, boosts, penalty).first()
        real = sampling.composition(sampling.weighted_top(rows, quota, sampling.row_weight(boosts, penalty), seed=3)).first()
        assert all(got[k] == pytest.approx(real[k]) for k in ("n", "noul", "score", "choice", "binary"))


def quotas_by_hand(n, family, total, caps, share):
    """Rounds as long as a family goes over its cap, each level by bisection."""
    most = {s: min(x, math.floor(share * total)) if share else x for s, x in n.items()}

    def solve(some, target):
        if sum(most[s] for s in some) <= target:
            return {s: most[s] for s in some}
        lo, hi = 0.0, 1e6
        for _ in range(100):
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(most[s], c * n[s] ** 0.5) for s in some) < target else (lo, c)
        return {s: int(min(most[s], lo * n[s] ** 0.5)) for s in some}

    held = {}
    while True:
        out = solve([s for s in n if family[s] not in held], max(0, total - sum(sum(q.values()) for q in held.values())))
        over = [f for f in caps if f not in held and sum(q for s, q in out.items() if family[s] == f) > caps[f] * total]
        if not over:
            return out | {s: q for f in held.values() for s, q in f.items()}
        held |= {f: solve([s for s in n if family[s] == f], caps[f] * total) for f in over}


@pytest.mark.parametrize("total,share,caps", [(900, None, {"f": 0.1}), (900, None, {"f": 0.3, "g": 0.25, "h": 0.2}), (500, 0.08, {"f": 0.05, "g": 0.9}), (10**6, None, {"f": 0.1}), (0, None, {"f": 0.1}), (700, None, {})])
def test_family_caps_go_to_a_fixed_point(spark, total, share, caps):
    n = {f"{f}{i}": (37 * (i + 1) * (k + 2)) % 211 + 3 for k, f in enumerate("fghx") for i in range(6)}
    family = {s: s[0] for s in n}
    counts = spark.createDataFrame([(s, family[s], x) for s, x in n.items()], "source string, family string, n long")
    got = {r["source"]: r["quota"] for r in selection.family_quotas(counts, F.lit(total), caps, share=share).collect()}
    want = quotas_by_hand(n, family, total, caps, share)
    assert got == want


def test_nth_least_by_key(spark):
    df = spark.createDataFrame([("a", f"{i:03}") for i in range(200)] + [("b", "x")], "source string, seq string").repartition(6)
    assert [tuple(r) for r in sampling.nth(df, "source", "seq", 30).collect()] == [("a", "029")]


def test_build_with_named_sizes(spark, tmp_path):
    rows = pool(spark).select("id", F.concat(F.lit("g"), "id").alias("group_id"), "id", "source", "dataset", "kind", "options")
    rows = pool(spark).withColumns({
        "case_id": F.col("id"), "variant": F.lit(None).cast("string"), "group_id": F.concat(F.lit("g:"), "id"), "split": F.lit("train"), "language": F.lit("en"), "license": F.lit("mit"),
        "state": F.concat(F.lit("unique state "), "id"), "question": F.lit("which?"), "target": F.expr("transform(options, (o, i) -> if(i = 0, 1.0D, 0.0D))"),
        "option_values": F.when(F.col("kind") == "score", F.expr("transform(options, (o, i) -> cast(i as double))")), "seq": F.col("id"),
    })
    s = mixture.Settings(max_options=5, per_source_cap=1000, sizes=selection.Sizes(**ASKED), work=str(tmp_path / "work"))
    built = mixture.build(rows, rows.where("false"), s)
    ids = {k: {r["id"] for r in built[k].select("id").collect()} for k in ("train", "train_mid", "train_small", "train_huge")}
    assert ids["train_small"] < ids["train_mid"] < ids["train"] and not ids["train_huge"] and built["solved"].converged
    assert built["train"].columns == [c for c in built["all_train"].columns if c != "reason"]
    assert built["ledger"].count() == 0 and built["all_train"].where("reason is null").count() == 2200
