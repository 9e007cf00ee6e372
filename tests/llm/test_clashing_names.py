"""Columns of documents whose names the operators use themselves are kept as they are."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard, line_chunks, mixing, pieces, quality
from quillon.llm.queries import vocabulary_file

from .test_operators import corpus

NAMES = (
    "gone n_ key_ chunks_ text_ n_lines_ n_removed_ lines_ hash_ held held0 held1 row row_ id_ component component_ least place cid size key n all_ nth_ position_ time other per h rest bucket inside before x "
    "copies positions target source_size source_rank s_ taken kept score n_words piece_id shard a`dot.ted"
).split()


def documents(spark):
    rows = [(i, t, s) for i, t, s in corpus(n=12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in NAMES if "`" not in n), F.lit("d").alias("a.b"))


STAGES = {
    "line_dedup": line_chunks.dedup,
    "keep_one": lambda d: jaccard.keep_one(d, shingle=5, num=80, den=100),
    "mixed": mixing.mixed,
    "keep_good": lambda d: quality.keep_good(d, None),
    "encode": lambda d: pieces.encode(d, vocabulary_file("piece_bpe_32k.model")).drop("piece_ids"),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_of_any_name(spark, stage):
    df = documents(spark)
    out = STAGES[stage](df)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows
    for r in rows:
        who = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[n] == f"{n}={who}" for n in NAMES if "`" not in n) and r["a.b"] == "d"
    assert STAGES[stage](df.where("false")).count() == 0


def test_positions_ascend(spark):
    df = documents(spark)
    times = [r["at"] for r in mixing.mixed(df, position="at").collect()]
    assert times == sorted(times) and len(times) == mixing.mixed(df).count() == mixing.plan(df).agg(F.sum("copies")).first()[0]


def test_mark_replaces_only_its_own_columns(spark):
    df = documents(spark)
    out = line_chunks.mark(df)
    assert [c for c in out.columns if c not in ("text_", "n_lines_", "n_removed_")] == [c for c in df.columns if c not in ("text_", "n_lines_", "n_removed_")]
    assert out.where("n_lines_ is null").count() == 0
