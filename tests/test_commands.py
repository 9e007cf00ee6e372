"""The commands, one after another: a build, its calibration and evaluation, and runs side by side."""

import json

import pytest
from pyspark.sql import functions as F

from quillon import __main__ as commands
from quillon.operators import evaluation
from quillon.sources import readers, writers

from .test_selection import KINDS, pool


@pytest.fixture(scope="module")
def decisions(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "decisions")
    rows = pool(spark, [(s, n // 6, k, o) for s, n, k, o in KINDS]).withColumns({
        "case_id": F.col("id"), "variant": F.lit(None).cast("string"), "group_id": F.concat(F.lit("g:"), "id"), "language": F.lit("en"), "license": F.lit("mit"),
        "split": F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, "validation").otherwise("train"), "state": F.concat(F.lit("unique state "), "id"), "question": F.lit("which?"),
        "target": F.expr("transform(options, (o, i) -> if(i = 0, 1.0D, 0.0D))"), "option_values": F.when(F.col("kind") == "score", F.expr("transform(options, (o, i) -> cast(i as double))")), "soft": F.lit(False),
    })
    writers.decisions(rows, path)
    return path


def run(capsys, *args):
    assert commands.main(list(args)) == 0
    out = capsys.readouterr().out
    return json.loads(out[out.index("{") :])


def test_build_is_a_snapshot(spark, decisions, tmp_path, capsys):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"decisions": decisions, "output": "{OUT}/mix", "build": {"max_options": 5, "total": 100, "sizes": {"total": 150, "sizes": {"small": 60}}}}))
    out = run(capsys, "build", "--config", str(config), "--root", f"OUT={tmp_path}", "--set", "build.sizes.total=120", 'build.excluded=["A/bin"]')
    manifest, here = writers.current(spark, f"{tmp_path}/mix")
    assert manifest["version"] == out["version"] and 100 <= manifest["tables"]["train"]["rows"] <= 120 and manifest["tables"]["train_small"]["rows"] <= 60
    train = spark.read.parquet(f"{here}/train")
    assert train.where("source = 'A/bin'").isEmpty() and spark.read.parquet(f"{here}/train_small").join(train, "id", "left_anti").isEmpty()
    assert {(r["reason"], r["pass"]) for r in manifest["drops"]} == {("excluded_source", "train")}
    config.write_text(json.dumps({"decisions": decisions, "output": "x", "build": {"nothing": 1}}))
    with pytest.raises(ValueError, match="unknown settings: nothing"):
        commands.main(["build", "--config", str(config)])


def test_calibrate_evaluate_compare(spark, decisions, tmp_path, capsys):
    rows = readers.decisions(spark, decisions).withColumn("logits", F.expr("transform(target, (t, i) -> 8 * t * if(xxhash64(id) % 3 = 0, -1, 1) + i)"))
    calib, other = rows.where("split = 'validation'"), rows.where("split = 'validation' and xxhash64(id, 1) % 2 = 0").withColumn("logits", F.when(F.col("kind") != "score", F.col("logits")))
    for name, df in (("calib", calib), ("other", other), ("train", rows)):
        df.write.parquet(f"{tmp_path}/{name}")
    found = run(capsys, "calibrate", f"{tmp_path}/calib", f"{tmp_path}/cal.json")
    assert found["nll_after"] < found["nll_before"] and set(found["temperatures"]) == {"noul", "choice", "score"} and all(t > 1 for t in found["temperatures"].values())
    with pytest.raises(ValueError, match="must come from validation"):
        evaluation.calibrate(rows)
    one = run(capsys, "evaluate", f"{tmp_path}/calib", f"{tmp_path}/eval/one", "--calibration", f"{tmp_path}/cal.json")
    two = run(capsys, "evaluate", f"{tmp_path}/other", f"{tmp_path}/eval/two")
    assert one["calibrated"] and not two["calibrated"] and [r["skipped"] for r in one["all"] if r["group_type"] == "all"] == [0] and two["all"][0]["skipped"] > 0
    with pytest.raises(PermissionError):
        commands.main(["evaluate", f"{tmp_path}/calib", f"{tmp_path}/eval/x", "--split", "test"])
    (tmp_path / "seen.txt").write_text("A/big\n\nA/noul\n")
    assert run(capsys, "compare", f"{tmp_path}/eval/one", f"{tmp_path}/eval/two", "--seen", f"{tmp_path}/seen.txt", "--sources", f"{tmp_path}/seen.txt")["rows"] == 2 * (1 + 2 + 2 + 1 + 2) + 1
    got = {(r["part"], r["value"], r["run"]): r for r in evaluation.compare({n: spark.read.parquet(f"{tmp_path}/eval/{n}") for n in ("one", "two")}, "one").collect()}
    assert got["all", "all", "one"]["gain"] is None and got["all", "all", "two"]["gain"] == pytest.approx(100 * (got["all", "all", "two"]["acc"] - got["all", "all", "one"]["acc"])) and ("kind", "score", "two") not in got
    with pytest.raises(ValueError, match="no run"):
        evaluation.compare({"one": rows}, "none")


def test_report(decisions, capsys):
    out = run(capsys, "report", decisions)
    assert out["diversity"][0]["n"] == 364 or out["diversity"][0]["n"] > 300
    assert sum(r["n"] for r in out["shares"] if r["field"] == "kind") == out["diversity"][0]["n"]
