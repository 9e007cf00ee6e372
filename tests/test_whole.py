"""Registered queries over whole texts against brute force on small tables."""

import pytest

from quillon.plans.catalogue import QUERIES

TEXTS = ["short", "a" * 196 + "    " + "b" * 300, " \n" * 3 + "c" * 5000 + " tail ", "d" * 197, "e" * 198, "x" * 90 + " " * 120 + "y" * 90]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_rendered_spans_take_whole_states(spark, tables):
    expected = {}
    for i, text in enumerate(TEXTS):
        for attr in ("quality", "toxic"):
            state, question, middle = text.strip(" "), f"Is it {attr}?", " […] "
            pre, post, options = "\n\nQuestion (noul):\n", "\n\nOptions:\n", ["yes", "no"]
            room = 256 - 1 - len("State:\n" + pre + question + post + "yes\nno\n")
            if len(state) > room:
                keep = room - len(middle)
                state = state[: keep // 2] + middle + state[len(state) - (keep - keep // 2) :]
            before = "#State:\n" + state + pre
            at = len(before + question + post)
            expected[f"{i}:{attr}"] = ("ok", at + len("yes\nno\n"), [(at, at + 3), (at + 4, at + 6)], (len(before), len(before + question)))
    got = {r["id"]: (r["status"], r["n"], [tuple(s) for s in r["spans"]], tuple(r["qspan"])) for r in QUERIES["rendered_spans"](spark, tables).collect()}
    assert got == expected


def test_middle_truncate_keeps_the_real_tail(spark, tmp_path):
    lengths = [1, 99, 100, 101, 300, 301, 5000]
    spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {}
    for i, n in enumerate(lengths):
        ids = list(range(1, n + 1))
        cut = ids if n <= 100 else ids[:48] + [0, 0, 0] + ids[-49:]
        expected[i] = (len(cut), sum(cut))
    assert {r["doc_id"]: (r["n"], r["s"]) for r in QUERIES["middle_truncate"](spark, str(tmp_path)).collect()} == expected


def test_unpermute_restores_whole_vectors(spark, tmp_path):
    rows = [(i, i * 7 % 64, [float(100 * i + k) for k in range(64)]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["at"], r["x"]) for r in QUERIES["unpermute"](spark, str(tmp_path)).collect()}
    assert got == {i: (at, e[at]) for i, at, e in rows}
