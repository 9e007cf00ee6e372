"""Writers: tables, reports and logs."""

from __future__ import annotations

import json
import re
import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import DECISION


def decisions(df: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    """Decisions in the fixed schema, zstd; an empty table still has a file with the schema."""
    fixed = df.select(*(F.col(f.name).cast(f.dataType) for f in DECISION.fields))
    fixed.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)


def csv_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as one sorted CSV file."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows as further JSON lines."""
    df.write.mode("append").json(path)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them: any store that Spark writes to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def text_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store, under its name only once it is whole."""
    store, to = _hadoop(spark, path)
    _, other = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(other, True)
    out.write(bytearray(text.encode()))
    out.close()
    if store.exists(to):
        store.delete(to, False)
    if not store.rename(other, to):
        raise OSError(f"couldn't rename to {path}")


class Snapshot:
    """A build whose tables and manifest appear together.

    Tables are written beneath <path>/versions/<name>, the manifest beside them last, and then the one-line file
    <path>/CURRENT is renamed into place: a reader that goes by it sees the whole build before or the whole build
    after, and one that began with the older goes on with its files. A build that fails leaves CURRENT as it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, dict] = {}

    @property
    def here(self) -> str:
        return f"{self.path}/versions/{self.version}"

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a table, its rows counted in the same pass, and gives it back as stored."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(f"{self.here}/{name}")
        self.tables[name] = {"rows": seen.get["n"], "columns": df.columns}
        return self.spark.read.schema(df.schema).parquet(f"{self.here}/{name}")

    def commit(self, **parts) -> dict:
        """Writes the manifest (tables, and plain values or small aggregates) and moves CURRENT to this version."""
        out = {"version": self.version, "tables": self.tables, **plain(**parts)}
        text_file(self.spark, f"{self.here}/manifest.json", json.dumps(out, indent=1, ensure_ascii=False, default=str))
        text_file(self.spark, f"{self.path}/CURRENT", self.version)
        return out


def current(spark: SparkSession, path: str) -> tuple[dict, str]:
    """(manifest, folder) of the last whole build."""
    version = spark.read.text(f"{path.rstrip('/')}/CURRENT").first()[0].strip()
    here = f"{path.rstrip('/')}/versions/{version}"
    return json.loads(spark.read.text(f"{here}/manifest.json", wholetext=True).first()[0]), here


def keep_versions(spark: SparkSession, path: str, most: int = 2) -> list[str]:
    """Deletes all versions but the newest and the current one; the names deleted."""
    now = spark.read.text(f"{path.rstrip('/')}/CURRENT").first()[0].strip()
    store, root = _hadoop(spark, f"{path.rstrip('/')}/versions")
    names = sorted(s.getPath().getName() for s in store.listStatus(root))
    gone = [n for n in names[: max(0, len(names) - most)] if n != now]
    for n in gone:
        store.delete(_hadoop(spark, f"{path.rstrip('/')}/versions/{n}")[1], True)
    return gone


def copied(spark: SparkSession, source: str, target: str) -> int:
    """Copies a folder, a file a task, through a staging folder that is renamed into place; how many files. The target must not exist."""
    store, root = _hadoop(spark, source)
    files, found = [], store.listFiles(root, True)
    while found.hasNext():
        files.append(found.next().getPath().toString())
    base = store.getFileStatus(root).getPath().toString().rstrip("/")
    stage = f"{target.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    out, to = _hadoop(spark, target)
    if out.exists(to):
        raise FileExistsError(target)

    def move(batches):
        from pyarrow import fs

        def opened(uri):
            return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri if "://" in uri else f"file://{uri}")

        for b in batches:
            for f in b["f"]:
                (a, at), (z, into) = opened(f), opened(f"{stage}/{f[len(base) + 1:]}")
                z.create_dir(into.rpartition("/")[0], recursive=True)
                other = f"{into}.{uuid.uuid4().hex}"
                with a.open_input_stream(at, compression=None) as i, z.open_output_stream(other, compression=None) as o:
                    while piece := i.read(1 << 22):
                        o.write(piece)
                z.move(other, into)
                yield pd.DataFrame({"f": [f]})

    n = spark.createDataFrame([(f,) for f in files], "f string").repartition(max(1, min(len(files), 1000)), "f").mapInPandas(move, "f string").count() if files else 0
    stage_path = _hadoop(spark, stage)[1]
    out.mkdirs(stage_path)
    if not out.rename(stage_path, to):
        raise OSError(f"couldn't rename to {target}")
    return n


def plain(**parts) -> dict:
    """Plain values as they are, and small aggregates as lists of rows."""
    return {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}


def source_list(df: DataFrame, path: str, key: str = "held_out_sources", column: str = "source") -> None:
    """The distinct names of a column as a YAML list under a key, in order; names are quoted as JSON, which YAML reads. A name a source, so it is collected."""
    names = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    text_file(df.sparkSession, path, f"{key}:\n" + "".join(f"- {json.dumps(n, ensure_ascii=False)}\n" for n in names) if names else f"{key}: []\n")


def manifest(path: str, **parts: DataFrame | int | float | str | bool | dict) -> dict:
    """A JSON manifest of plain values and of small aggregates, which are collected."""
    out = plain(**parts)
    text_file(SparkSession.active(), path, json.dumps(out, indent=1, ensure_ascii=False, default=str))
    return out


def markdown(df: DataFrame, digits: int = 1) -> str:
    """A small table in Markdown, nulls as "-"."""
    show = lambda x: "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    rows = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(rows + ["| " + " | ".join(map(show, r)) + " |" for r in df.collect()])
