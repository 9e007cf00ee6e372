"""A whole build over planted rows."""

from pyspark.sql import functions as F

from quillon.operators import mixture, score
from quillon.schema import DECISION


def row(i, source, split, state, **kw):
    base = dict(id=i, case_id=i, group_id=f"g{i}", dataset=source[0], source=source, split=split, language="en", license="mit", kind="choice", state=state, question="which?", options=["a", "b"], target=[0.0, 1.0], option_values=None, soft=False, variant=None)
    base |= kw
    return tuple(base[f.name] for f in DECISION.fields)


def test_build(spark):
    ev = [row("v1", "A/x", "validation", "seen before"), row("v2", "A/x", "validation", "nc guards too", license="cc-by-nc-4.0"), row("e1", "A/x", "test", "a test"), row("e2", "H/t", "test", "held")]
    tr = [
        row("a1", "A/x", "train", "fresh one"), row("a2", "A/x", "train", "fresh two"), row("a3", "A/x", "train", "SEEN  before"), row("a4", "B/y", "train", "nc guards too"), row("a5", "A/x", "train", "other", group_id="ge1"), row("a6", "A/x", "train", "fresh one"),
        row("a7", "H/t", "train", "task"), row("a8", "A/x", "train", "x" * 1001), row("a9", "A/x", "train", "free", license="cc-by-nc-4.0"), row("a10", "A/x", "train", "free", license="other"), row("a11", "X/z", "train", "gone"),
        row("a12", "A/x", "train", "many", options=list("abcd"), target=[0.25] * 4), row("a13", "A/x", "train", "cut", options=list("abcd"), target=[0.0, 1.0, 0.0, 0.0]), row("a14", "A/x", "train", "bad", target=[1.0]), row("b1", "B/y", "train", "fresh three"),
    ]
    frame = lambda rows: spark.createDataFrame(rows, DECISION).withColumn("seq", F.monotonically_increasing_id())
    out = mixture.build(frame(tr).coalesce(1), frame(ev), mixture.Settings(max_chars=1000, max_options=3, held_out=["H/*"], excluded=["X/*"]))
    assert {r["id"] for r in out["train"].collect()} == {"a1", "a2", "a13", "b1"}
    why = {r["id"]: r["reason"] for r in out["all_train"].where("reason is not null").collect()}
    assert why == {"a3": "leak_state", "a4": "leak_state", "a5": "leak_group", "a6": "duplicate", "a7": "held_out_task", "a8": "state_too_long", "a9": "license:non_commercial", "a10": "license:unknown_license", "a11": "excluded_source", "a12": "too_many_target_options", "a14": "target_len_mismatch"}
    assert [r["id"] for r in out["heldout"].collect()] == ["e2"] and [r["id"] for r in out["test"].collect()] == ["e1"]
    mixture.check(out)


def test_scorer_halves_batches(spark):
    df = spark.createDataFrame([row(f"r{i}", "A/x", "test", "s" * i) for i in range(1, 9)], DECISION)

    def small(rows):
        if len(rows) > 2 or rows["state"].str.len().max() == 8:
            raise MemoryError
        return score.uniform_scorer(rows)

    got = {r["id"]: (r["logits"], r["status"]) for r in score.predict(df, small, partitions=1).collect()}
    assert got["r8"] == (None, "unsupported") and all(got[f"r{i}"] == ([0.0, 0.0], "ok") for i in range(1, 8))
    assert score.predict(df, score.hashed_scorer).where("status = 'ok'").count() == 8
