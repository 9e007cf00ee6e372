"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quillon.plans import catalogue

HEADLINE = (
    "leak_ngram", "leak_free_by_lang", "drop_ledger", "exact_dedup_keep_first", "fingerprints_per_doc", "temperature_quotas", "weighted_topq", "bottomk_per_source", "cap_options",
    "license_policy_counts", "group_metrics_grouping_sets", "reliability_table", "selective_risk", "temperature_grid", "prior_reference", "label_novelty", "diversity_report", "manifest_counts", "letter_prompt", "length_bucket_batches",
)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):  # one to warm up, then the better of two
            t = time.perf_counter()
            catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
            if times[-1] > 20:
                break
        took[name] = round(min(times[1:] or times), 3)
    print(json.dumps({"metric": "sum of the headline queries' seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "median": statistics.median(took.values()), "sf": d}))


if __name__ == "__main__":
    main()
