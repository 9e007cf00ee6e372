"""The pipeline's stages on the smallest table."""

import corpus_pipeline


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        assert docs.columns == columns + ["piece_ids"] * (i == len(corpus_pipeline.STAGES) - 1)
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4] > 0
