"""Guards over streams: arriving rows against a fixed index, and drops counted by window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def guarded(stream: DataFrame, known: DataFrame, on: str) -> DataFrame:
    """The rows of a stream whose key isn't known; the index is a table, joined anew for each micro-batch."""
    return stream.join(known.select(on).distinct(), on, "left_anti")


def windowed_ledger(stream: DataFrame, time: str, reason: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and reason, late rows up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), reason).agg(F.count("*").alias("n"))


def counted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of other types than error, counted by a stream that ends when it has read all there is."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet") if _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    known = spark.createDataFrame([("error",)], "event_type string")
    counts = guarded(stream, known, "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    name = f"stream_{uuid.uuid4().hex}"
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
