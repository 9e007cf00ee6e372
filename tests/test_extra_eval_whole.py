"""The extra evaluation queries put every row of a source through the leak filter."""

from quillon.plans.catalogue import QUERIES


def test_all_rows_of_a_source_count(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "src2" if i % 2 else "src0", 100) for i in range(90)]
    rows += [(100 + i, " ".join(f"t{i}x{k}" for k in range(30)), "en", "src1", 100) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a text of its own")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["source"]: (r["n_rows"], r["verdict"]) for r in QUERIES["extra_eval_sources"](spark, str(tmp_path)).collect()}
    assert got == {"src0": (45, "chosen"), "src2": (45, "chosen")}
