"""A dataset's splits as a Spark data source, read whole or as a stream.

``spark.read.format("quillon_dataset")`` and ``spark.readStream`` read the files of one split of a dataset: a folder with
Parquet or JSON-lines files beneath <split>/ or named <split>-*.  Each file, or a Parquet file's row group, is a partition;
columns are cut before decoding, equality filters and the limit of rows for each partition are applied while
reading. As a stream, an offset is a number of files in the order of their names, so files that come later are read later.

Options: path, split (train), columns (comma-separated; all), rows (a limit for the whole split, kept by dealing it to
partitions in order, which needs the files' row counts: Parquet's are read from their footers, JSON lines are counted),
files (for a stream: how many a batch takes, 1).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

NAME = "quillon_dataset"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _files(path: str, split: str) -> list[str]:
    """The split's files, by name."""
    from pyarrow import fs

    store, root = _filesystem(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    mine = re.compile(rf"(?:^|/){re.escape(split)}(?:/[^/]+|-[^/]*)\.(?:parquet|jsonl(?:\.gz)?)$")
    return sorted(f.path for f in found if f.type == fs.FileType.File and mine.search(f.path[len(root.rstrip("/")) :]))


@dataclass
class Part(InputPartition):
    """A file, or one row group of it, and how many of its rows to read (-1: all)."""

    file: str
    group: int = -1
    most: int = -1


class _Files:
    def __init__(self, schema, options: dict):
        self.schema, self.path, self.split = schema, options["path"], options.get("split", "train")
        self.rows = int(options["rows"]) if "rows" in options else None
        self.equal: list[tuple[str, object]] = []

    def groups(self, files: list[str]) -> Iterator[Part]:
        import pyarrow.parquet as pq

        store, _ = _filesystem(self.path)
        left = self.rows
        for f in files:
            if f.endswith(".parquet"):
                meta = pq.ParquetFile(f, filesystem=store).metadata
                sizes = [(i, meta.row_group(i).num_rows) for i in range(meta.num_row_groups)]
            elif left is None:
                sizes = [(-1, -1)]
            else:
                with store.open_input_stream(f, compression="detect") as lines:
                    sizes = [(-1, sum(chunk.count(b"\n") for chunk in iter(lambda: lines.read(1 << 20), b"")))]
            for group, n in sizes:
                if left == 0:
                    return
                most = -1 if left is None else min(left, n)
                left = left if left is None else left - most
                yield Part(f, group, most)

    def batches(self, part: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = _filesystem(self.path)
        want = to_arrow_schema(self.schema)
        left = part.most if part.most >= 0 else None
        if part.file.endswith(".parquet"):
            found = pq.ParquetFile(part.file, filesystem=store).iter_batches(4096, row_groups=[part.group], columns=want.names)
        else:
            found = self._lines(store, part.file, want)
        for b in found:
            b = pa.RecordBatch.from_arrays([b.column(n).cast(want.field(n).type) for n in want.names], schema=want)
            b = b if left is None else b.slice(0, left)
            left = left if left is None else left - b.num_rows
            for name, value in self.equal:
                b = b.filter(pc.equal(b.column(name), pa.scalar(value, want.field(name).type)))
            if b.num_rows:
                yield b
            if left == 0:
                return

    @staticmethod
    def _lines(store, file: str, want: pa.Schema) -> Iterator[pa.RecordBatch]:
        import io

        with store.open_input_stream(file, compression="detect") as raw:
            rows = []
            for line in io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8"):
                row = json.loads(line)
                rows.append({n: row.get(n) for n in want.names})
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_pylist(rows, want)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, want)


class Whole(_Files, DataSourceReader):
    def pushFilters(self, filters):
        """Takes equality of top-level columns; the rest stays with Spark, and so does everything where rows are limited, as a limit comes first."""
        for f in filters:
            if self.rows is None and isinstance(f, EqualTo) and len(f.attribute) == 1 and f.value is not None:
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        return list(self.groups(_files(self.path, self.split))) or [Part("")]

    def read(self, part):
        return self.batches(part) if part.file else iter(())


class Stream(_Files, DataSourceStreamReader):
    def __init__(self, schema, options: dict):
        super().__init__(schema, options)
        self.rows, self.each, self.at = None, int(options.get("files", 1)), 0

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        self.at = min(len(_files(self.path, self.split)), self.at + self.each)
        return {"files": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["files"])
        return list(self.groups(_files(self.path, self.split)[start["files"] : end["files"]]))

    def read(self, part):
        return self.batches(part)

    def commit(self, end):
        """Nothing to give back: files stay."""


class Dataset(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        """Of the first file: a Parquet file's own, or text for each key of the first JSON line."""
        import io

        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema
        from pyspark.sql.types import StringType, StructField, StructType

        files = _files(self.options["path"], self.options.get("split", "train"))
        if not files:
            raise ValueError(f"no files of split {self.options.get('split', 'train')} in {self.options['path']}")
        store, _ = _filesystem(self.options["path"])
        if files[0].endswith(".parquet"):
            found = from_arrow_schema(pq.ParquetFile(files[0], filesystem=store).schema_arrow)
        else:
            with store.open_input_stream(files[0], compression="detect") as raw:
                keys = json.loads(io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8").readline())
            found = StructType([StructField(k, StringType()) for k in keys])
        some = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([found[c] for c in some]) if some else found

    def reader(self, schema):
        return Whole(schema, dict(self.options))

    def streamReader(self, schema):
        return Stream(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Dataset)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
