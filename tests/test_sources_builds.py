"""Sources and writers, converters, requests and answers, JSON and running averages."""

import gzip
import io
import json
import tarfile
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays, variants
from quillon.operators import converters, engine, ingest, render, score, steps
from quillon.sources import dataset, readers, writers


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A dataset of two Parquet files and one of JSON lines in train, one in test."""
    root = tmp_path_factory.mktemp("data")
    (root / "train").mkdir()
    for i in range(2):
        pd.DataFrame({"id": range(100 * i, 100 * i + 100), "name": [f"n{k % 3}" for k in range(100)], "more": ["x" * 50] * 100}).to_parquet(root / "train" / f"{i}.parquet", row_group_size=30)
    with gzip.open(root / "train" / "2.jsonl.gz", "wt") as f:
        f.writelines(json.dumps({"name": f"n{k % 3}", "id": k}) + "\n" for k in range(200, 250))
    pd.DataFrame({"id": [9], "name": ["t"], "more": ["y"]}).to_parquet(root / "test-0.parquet")
    dataset.register(spark)
    return str(root)


def test_dataset_splits_columns_filters_and_limits(spark, stored):
    read = lambda **o: spark.read.format(dataset.NAME).options(path=stored, columns="id,name", **o).load()
    whole = read()
    assert whole.columns == ["id", "name"] and sorted(r["id"] for r in whole.collect()) == list(range(250))
    assert [tuple(r) for r in read(split="test").collect()] == [(9, "t")]
    assert sorted(r["id"] for r in whole.where("name = 'n1'").collect()) == sorted(k for k in range(250) if (k if k >= 200 else k % 100) % 3 == 1)
    assert sorted(r["id"] for r in read(rows="130").collect()) == list(range(130))
    assert read(rows="230").where("name = 'n1'").count() == sum((k if k >= 200 else k % 100) % 3 == 1 for k in range(230))
    with pytest.raises(Exception, match="no files of split"):
        read(split="none").collect()


def test_dataset_as_a_stream_has_the_same_rows(spark, stored, tmp_path):
    stream = spark.readStream.format(dataset.NAME).options(path=stored, columns="id,name").load()
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(300):
            if q.lastProgress and spark.read.schema("id long, name string").parquet(str(tmp_path / "o")).count() == 250:
                break
            q.awaitTermination(0.2)
    finally:
        q.stop()
    batch = spark.read.format(dataset.NAME).options(path=stored, columns="id,name").load()
    assert batch.exceptAll(spark.read.parquet(str(tmp_path / "o"))).count() == 0 == spark.read.parquet(str(tmp_path / "o")).exceptAll(batch).count()


def test_archive_members_are_streamed(spark, tmp_path):
    line = ("x" * 990 + "\n").encode()
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz", compresslevel=1) as tar:
        for name, data in (("en/train.jsonl", "é1\r\n2\n\n4".encode()), ("readme.txt", b"no"), ("en/big.jsonl", line * 60_000), ("en/empty.jsonl", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    df = readers.archive_lines(spark, str(tmp_path / "*.tar.gz"), r"\.jsonl$")
    assert [(r["line_no"], r["value"]) for r in df.where("member = 'en/train.jsonl'").orderBy("line_no").collect()] == [(1, "é1"), (2, "2"), (3, ""), (4, "4")]
    assert df.groupBy("member").count().collect()[0][1] in (4, 60_000) and df.count() == 60_004
    tracemalloc.start()
    for part in readers._members(f"file://{tmp_path}/a.tar.gz", "big"):  # 60 MB, of which a few are held
        assert len(part) <= readers.LINES
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_front_matter_of_whole_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntype: x\n---\nbody\nmore [l](b.md)\n")
    (tmp_path / "b.md").write_text("no header\n[x](gone.md)")
    pages = readers.front_matter(spark, str(tmp_path / "*.md"))
    got = {r["path"][-4:]: (r["header"], r["body"]) for r in pages.collect()}
    assert got == {"a.md": ("type: x", "body\nmore [l](b.md)\n"), "b.md": (None, "no header\n[x](gone.md)")}
    assert [r["target"] for r in readers.broken_links(pages).collect()] == ["gone.md"]


def test_a_reader_never_sees_half_a_build(spark, tmp_path):
    root = str(tmp_path / "build")
    one = writers.Snapshot(spark, root)
    assert one.table("train", spark.range(5)).count() == 5
    one.commit(note="first", by=spark.range(3).groupBy(F.col("id") % 2).count())
    seen, here = writers.current(spark, root)
    assert seen["tables"]["train"] == {"rows": 5, "columns": ["id"]} and seen["note"] == "first" and spark.read.parquet(f"{here}/train").count() == 5
    two = writers.Snapshot(spark, root)
    two.table("train", spark.range(9))
    assert writers.current(spark, root)[0] == seen  # not committed: the first build is still the one
    three = writers.Snapshot(spark, root)
    three.table("train", spark.range(7))
    three.commit()
    assert writers.current(spark, root)[0]["tables"]["train"]["rows"] == 7 and spark.read.parquet(f"{here}/train").count() == 5
    assert writers.keep_versions(spark, root, 1) and writers.current(spark, root)[0]["tables"]["train"]["rows"] == 7
    assert writers.copied(spark, root, str(tmp_path / "copy")) >= 3 and writers.current(spark, str(tmp_path / "copy"))[0]["tables"]["train"]["rows"] == 7
    with pytest.raises(FileExistsError):
        writers.copied(spark, root, str(tmp_path / "copy"))


def test_manifest_and_source_list(spark, tmp_path):
    assert writers.manifest(str(tmp_path / "m.json"), n=1, rows=spark.range(2))["rows"] == [{"id": 0}, {"id": 1}]
    df = spark.createDataFrame([("b/ø",), ("a: x",), ("b/ø",), (None,)], "source string")
    writers.source_list(df, str(tmp_path / "held.yaml"))
    assert (tmp_path / "held.yaml").read_text() == 'held_out_sources:\n- "a: x"\n- "b/ø"\n'
    writers.source_list(df.where("false"), str(tmp_path / "none.yaml"))
    assert (tmp_path / "none.yaml").read_text() == "held_out_sources: []\n"
    (tmp_path / "c.json").write_text('{"a": "{ROOT}/x", "b": ["{ROOT}"]}')
    assert readers.config(str(tmp_path / "c.json"), ROOT="/d") == {"a": "/d/x", "b": ["/d"]}


def test_converters_by_name_write_once_and_keep_a_ledger(spark, tmp_path):
    rows = spark.createDataFrame([(i, "p", "r", i % 6, 1, 2, 3, None) for i in range(12)], "row long, prompt string, response string, helpfulness int, correctness int, coherence int, complexity int, verbosity int")
    rows.write.parquet(str(tmp_path / "up" / "train"))
    asked = '{"q": {"type": "noul", "instructions": "?", "criteria": "{\\"true\\": \\"y\\", \\"false\\": \\"n\\"}"}, "z": {"type": "rank", "instructions": "?", "criteria": ""}}'
    other = spark.createDataFrame([("a", "w", '{"k": "v"}', asked, '{"q": {"probabilities": {"true": 1.0}}, "z": {"probabilities": {"true": 1.0}}}')], "id string, workflow string, state string, questions string, gold string")
    sources = {"rated": {"converter": "ratings", "dataset": "rated", "index": "row", "path": str(tmp_path / "up" / "{split}")}, "wf": {"converter": "json_columns", "dataset": "wf", "rows": other}, "off": {"converter": "flat", "enabled": False}}
    ledger = {(r["source"], r["reason"]): r["n"] for r in converters.collected(spark, sources, "train", str(tmp_path / "out")).collect()}
    assert ledger == {("rated", "kept"): 46, ("rated", "rated_bad_rating"): 14, ("wf", "kept"): 1, ("wf", "wf_unsupported_type:*"): 1}
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("source").count().count() >= 2
    with pytest.raises(ValueError, match="no converter"):
        converters.converted(spark, "nothing", {}, "train")
    with pytest.raises(ValueError, match="already"):
        converters.register("flat", list)(lambda *a: None)


def requests(spark, rows):
    return spark.createDataFrame(rows, f"id string, state string, questions map<string,{engine.QUESTION}>")


def test_requests_are_answered_whole_or_refused_whole(spark):
    noul, who = ("noul", "ok?", None), ("choice", "who?", {"x": "long option", "y": "s"})
    rows = [("a", "st", {"p": noul, "w": who}), ("b", "st", {"p": noul, "odd": ("rank", "?", None)}), ("c", "s" * 500, {"p": noul}), ("d", "st", {"w": ("choice", "?", {"x": "o" * 200, "y": "z"})}), ("e", None, {"p": noul}), ("f", "st", {}), ("g", "st", None), ("h", "st", {"w": ("choice", "?", {})})]
    got = {r["id"]: r for r in engine.answer(requests(spark, rows), score.length_scorer, max_len=300, max_option=160, orders=4).collect()}
    assert {k: r["refusal"] for k, r in got.items()} == {"a": None, "b": "unsupported_type", "c": "prompt_too_long", "d": "option_too_long", "e": None, "f": "no_questions", "g": "no_questions", "h": "no_options"}
    a = got["a"]["answers"]
    assert set(a) == {"p", "w"} and a["w"]["choice"] == "x" and a["w"]["keys"] == ["x", "y"] and sum(a["w"]["probabilities"]) == pytest.approx(1) and a["p"]["noul"] > 0.5 and got["b"]["answers"] is None


def test_temperature_changes_confidence_not_choice(spark):
    r = requests(spark, [("a", "st", {"w": ("choice", "?", {"x": "s", "y": "longer", "z": "longest"})})])
    one, two = (engine.answer(r, score.length_scorer, temperatures={"choice": t}).first()["answers"]["w"] for t in (1.0, 5.0))
    assert one["choice"] == two["choice"] == "z" and max(one["probabilities"]) > max(two["probabilities"])


def test_letters_have_an_end_and_memory_may_not_suffice(spark):
    many = requests(spark, [("a", "st", {"w": ("choice", "?", {f"k{i:02}": f"o{i}" for i in range(27)})}), ("b", "st", {"p": ("noul", "?", None)})])
    assert {r["id"]: r["refusal"] for r in engine.answer(many, score.uniform_scorer, mode="letter").collect()} == {"a": "too_many_options", "b": None}

    def small(rows):
        if len(rows) > 1 or "big" in rows["state"].iloc[0]:
            raise MemoryError
        return [[0.0] * len(o) for o in rows["options"]]

    both = requests(spark, [("a", "st", {"p": ("noul", "?", None), "q": ("noul", "?", None)}), ("b", "big", {"p": ("noul", "?", None)})])
    got = {r["id"]: r for r in engine.answer(both, small, batch=4).collect()}
    assert got["a"]["status"] == "ok" and got["a"]["answers"]["q"]["noul"] == 0.5 and got["b"]["refusal"] == "out_of_memory"


def test_json_styles_maps_and_sketches(spark):
    texts = ['{"b": [1, 2.0], "a": "é\\n"}', '"plain \\u00e9"', "no json", None, "[]", "7", "[" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *(variants.written(F.col("t"), s).alias(s) for s in variants.STYLES), variants.sketch(F.col("t")).alias("shape")).orderBy("i").collect()
    for r, t in zip(rows, texts, strict=True):
        try:
            v = json.loads(t)
        except (TypeError, ValueError, RecursionError):
            assert [r[s] for s in variants.STYLES] == [None] * 3 and r["shape"] is None
            continue
        if isinstance(v, str):
            assert [r[s] for s in variants.STYLES] == [v] * 3
        else:
            assert r["compact"] == json.dumps(v, ensure_ascii=False, separators=(",", ":")) and r["sorted"] == json.dumps(v, ensure_ascii=False, sort_keys=True) and r["plain"] == json.dumps(v)
            assert all(json.loads(r[s]) == v for s in variants.STYLES)
    assert rows[0]["shape"] == '{"b": [2, 1], "a": "é\\n"}' and rows[4]["shape"] == "[]"
    deep = spark.createDataFrame([('{"a": {"b": {"c": {"d": {"e": 1}, "l": [1]}}}}',)], "t string").select(variants.sketch(F.col("t"))).first()[0]
    assert deep == '{"a": {"b": {"c": {"d": "dict", "l": "list"}}}}'
    keyed = spark.createDataFrame([('{"x": 1}',), ('[{"id": "k", "v": 1}, {"name": "k", "v": 2}, {"v": 3}, 4]',), ("5",), ("[]",)], "t string").select(F.map_keys(variants.by_key(F.parse_json("t"))).alias("k")).collect()
    assert [sorted(r["k"]) for r in keyed] == [["x"], ["2", "k"], [], []]


@pytest.mark.parametrize("segment", [4, 64])
def test_running_average_of_a_long_series(spark, segment):
    at = [i for i in range(700) if i % 7 != 3]
    df = spark.createDataFrame([(k, i, float((i * 37) % 11) + len(k)) for k in ("a", "bb") for i in at] + [("a", None, 1.0), (None, 1, 1.0), ("a", 10**4, None)], "k string, step long, x double").repartition(5)
    got = {(r["k"], r["step"]): r["ema"] for r in steps.ema(df, "k", "step", "x", 0.98, 1.5, segment).collect()}
    assert len(got) == 2 * len(at)
    for k in ("a", "bb"):
        e = 1.5
        for i in at:
            d = min(0.98, (1 + i) / (10 + i))
            e = d * e + (1 - d) * (float((i * 37) % 11) + len(k))
            assert got[k, i] == pytest.approx(e)


def test_learning_rate(spark):
    got = [r[0] for r in spark.range(0, 101, 10).select(arrays.lr_factor(F.col("id"), 100, 20)).collect()]
    assert got[0] == pytest.approx(0.05) and got[1] == pytest.approx(0.55) and got[2] == pytest.approx(1.0) and got[-1] == pytest.approx(0.1) and got[2:] == sorted(got[2:], reverse=True)


def test_padded_batches_and_flat_rows(spark):
    df = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3]), (1, 0, [])], "batch int, place int, input_ids array<int>")
    assert {r["batch"]: (r["input_ids"], r["lengths"]) for r in render.pack(df, "batch").collect()} == {0: ([[1, 2], [3, 0]], [2, 1]), 1: ([[]], [0])}
    rows = spark.createDataFrame([("1", "g", "s", "dev", "mit", None, "noul", "st", "q", ["a", "b"], [0.25], None), ("2", "g", "s", "validation", "mit", None, "score", "st", "q", ["a", "b"], [0.0, 2.0], None)], "id string, group_id string, source string, split string, license string, license_use string, kind string, state string, question string, options array<string>, target array<double>, variant string")
    got = {r["id"]: r for r in ingest.flat(rows, "validation", "d").collect()}
    assert got["1"]["target"] == [0.25, 0.75] and got["1"]["options"] == ["yes", "no"] and got["2"]["target"] == [0.0, 1.0] and got["2"]["option_values"] == [0.0, 1.0] and not any(r["drop_reason"] for r in got.values())
