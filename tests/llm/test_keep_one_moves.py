"""How often whole rows are shuffled to keep one of each component, and what is kept then."""

import re

import pytest

from quillon.llm import jaccard


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables this small would be broadcast
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_move_once(shuffled):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a + " x"), (3, b), (3, b), (3, b + " y"), (None, b + " z"), (None, " \n"), (None, None), (4, None), (4, ""), (5, "one word")]
    kept = jaccard.keep_one(shuffled.createDataFrame(rows, "doc_id long, text string"), shingle=5, num=80, den=100)
    plan = kept._jdf.queryExecution().explainString(kept.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moves = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert sum("held#" in x or "text#" in x for x in moves) == 1, plan
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (3, b), (None, " \n"), (None, None), (4, None), (5, "one word")], key=str)
