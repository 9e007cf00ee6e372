"""What the operators of this package share: the shared folder, cut lineage, and words."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where it is unset and Spark runs in one process (tests), a folder of this session's own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _local[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder, in folders by some columns: cuts its lineage, and outlives lost executors. ``dropped`` deletes it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # what the job shuffled may go now
    out = spark.read.schema(df.schema).parquet(path)
    out.path_written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` once nothing is going to read them, through Hadoop's own file systems."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.path_written)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, **columns: T.DataType) -> DataFrame:
    """Only the named columns, cast to their types, so that further columns of any name can't clash."""
    return df.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns.items()))


def held(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of docs as held0, held1, ..., so that no name of theirs can clash with an operator's, and more columns made from docs."""
    return docs.select(*(F.col(f"`{c}`").alias(f"held{i}") for i, c in enumerate(docs.columns)), *more)


def given_back(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of docs from what ``held`` made, but for those given instead."""
    return [instead.get(c, F.col(f"held{i}")).alias(c) for i, c in enumerate(docs.columns)]


def words(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8; bytes.split() parts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, which executors' limits count."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def filesystem(uri: str):
    """(pyarrow file system, path) for a folder that executors write to: file, HDFS or an object store."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Writes one whole file under its final name; a second attempt of a task writes the same bytes again."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(other) as out:
        out.write(data)
    fs.move(other, path)


class Memo(dict):
    """A bounded memo in two generations: when one is full it becomes the old one, from which what is still used moves over."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
