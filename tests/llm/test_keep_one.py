"""Survivors of near-duplicate components where ids are missing or stand on several texts."""

from quillon.llm import jaccard


def text(name, n=60, tail=""):
    return " ".join(f"{name}{i}" for i in range(n)) + tail


def test_null_and_shared_ids(spark):
    rows = [
        (None, text("a"), "copies without an id"), (None, text("a"), "copies without an id"), (None, text("a", tail=" more"), "copies without an id"),
        (1, text("b"), "of id 1"), (1, text("c"), "of id 1, apart"), (2, text("c", tail=" more"), "near the second of id 1"), (None, text("b"), "without an id, of id 1"),
        (5, text("e"), "twice"), (5, text("e"), "twice"), (6, text("f", tail=" x"), "same id, near"), (6, text("f"), "same id, near"),
        (7, "", "no words"), (7, " ", "no words"), (None, "", "no words, no id"), (None, None, "no words, no id"), (8, None, "null"), (9, text("g"), "alone"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    got = sorted((tuple(r) for r in jaccard.keep_one(df, shingle=5, num=80, den=100).collect()), key=str)
    a = [r for r in got if r[2] == "copies without an id"]
    assert len(a) == 1 and a[0] == rows[0]
    assert [r for r in got if r not in a] == sorted([rows[3], rows[4], rows[7], rows[10], rows[11], rows[13], rows[14], rows[15], rows[16]], key=str)
