"""Vectors of great length: scores are exact up to 64 bits and an error beyond."""

import pytest

from quillon.llm import mtree


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return [tuple(r) for r in mtree.top_k(df, k=10).orderBy("query_id", "rank").collect()]


def test_long_vectors_are_exact(spark):
    big = float(2**20)
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [-big, 3.0]), (3, [float("inf"), 1.0]), (4, [float("nan")]), (5, [None])]
    a = 1024 * 2**20
    assert found(spark, rows) == [(0, 1, 1, a * a), (0, 2, 2, -a * a + 1024 * 3072)]


@pytest.mark.parametrize("x", [1e18, 1e300, 1.7e308])
def test_scores_that_do_not_fit_are_an_error(spark, x):
    with pytest.raises(ValueError, match="64 bits"):
        found(spark, [(0, [x, 0.0]), (1, [x, 1.0])])
