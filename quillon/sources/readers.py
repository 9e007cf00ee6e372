"""Readers: decisions, JSON lines and documents, manifests, archives, logs, front matter and configurations."""

from __future__ import annotations

import json
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DECISION


def decisions(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table of decisions; only the named columns are read."""
    df = spark.read.schema(DECISION).parquet(path)
    return df.select(*columns) if columns else df


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """df with each row's position in its Parquet file."""
    return df.withColumn(name, F.col("_metadata.row_index"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Lines of JSON, compressed or not; without a schema each line as a variant."""
    if schema:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def manifest_files(manifest: DataFrame, quarantine: DataFrame, split: str) -> DataFrame:
    """Manifest entries (dataset, split, path) of a split whose dataset isn't in quarantine."""
    return manifest.where(F.col("split") == split).join(quarantine.select("dataset").distinct(), "dataset", "left_anti")


def manifest_scan(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The Parquet files that manifest entries name; their paths are collected, one a file."""
    paths = [r["path"] for r in files.select("path").distinct().orderBy("path").collect()]
    return spark.read.parquet(*paths)


#: Bytes of a member read at a time, and lines handed on together.
PIECE, LINES = 1 << 20, 2048
PACKED = {(".gz", ".tgz"): "gzip", (".bz2", ".tbz2", ".tbz"): "bz2", (".zst", ".tzst"): "zstd"}


def archive_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(archive, member, line_no, value): lines of an archive's members whose names match the pattern; one archive is one task.

    An archive is streamed from its file system and its members are decompressed piece by piece, so a task holds a few
    megabytes and the longest line, whatever the size of a member. A member that isn't UTF-8 has its bad bytes replaced.
    """
    names = spark.read.format("binaryFile").load(path).select("path")  # without the content column, files aren't read

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where in b["path"]:
                yield from _members(where, member)

    return names.repartition("path").mapInPandas(unpack, "archive string, member string, line_no long, value string")


def _lines(raw) -> Iterator[bytes]:
    """Lines of a file that can only be read onwards; a line may span pieces."""
    rest: list[bytes] = []
    while piece := raw.read(PIECE):
        first, *more = piece.split(b"\n")
        rest.append(first)
        for line in more:
            yield b"".join(rest)
            rest = [line]
    if last := b"".join(rest):
        yield last


def _members(where: str, member: str) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(where.replace("file:/", "file:///", 1) if re.match("file:/[^/]", where) else where)
    packed = next((codec for ends, codec in PACKED.items() if path.endswith(ends)), None)  # decompressed by pieces here: tarfile expands a whole buffer at once
    with store.open_input_stream(path, compression=packed) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
        for m in tar:
            if m.isfile() and re.search(member, m.name):
                rows, at = [], 0
                for line in _lines(tar.extractfile(m)):
                    at += 1
                    rows.append((where, m.name, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
                    if len(rows) == LINES or len(line) > PIECE:
                        yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "value"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "value"])


def eval_log(lines: DataFrame, key: str = "eval") -> DataFrame:
    """Evaluation records of log lines (line_no, value), JSON or Python's notation: the last of each step, by step."""
    record = F.from_json(F.regexp_extract("value", r"(\{.*\})", 1), f"struct<{key}:struct<step:long,val_nll:double,val_acc:double,val_ece:double,val_n:long>>", {"allowSingleQuotes": "true", "allowNonNumericNumbers": "true"})
    found = lines.select("line_no", record[key].alias("e")).where("e.step is not null")
    return found.groupBy(F.col("e.step").alias("step")).agg(F.max_by("e", "line_no").alias("e")).select("step", "e.val_nll", "e.val_acc", "e.val_ece", "e.val_n").orderBy("step")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, body) of Markdown files; header is the text between the opening rules, or null."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    has = F.col("value").rlike(pattern)
    return whole.select("path", F.when(has, F.regexp_extract("value", pattern, 1)).alias("header"), F.when(has, F.regexp_extract("value", pattern, 2)).otherwise(F.col("value")).alias("body"))


def broken_links(pages: DataFrame) -> DataFrame:
    """(path, target): relative links of pages (path, body) to pages that aren't there."""
    links = pages.select("path", F.explode(F.expr(r"regexp_extract_all(body, '\\]\\(([^)#:\\s]+\\.md)(#[^)]*)?\\)', 1)")).alias("target"))
    here = links.withColumn("full", F.concat(F.regexp_replace("path", r"[^/]*$", ""), F.regexp_replace("target", r"^\./", "")))
    return here.join(pages.select(F.col("path").alias("full")), "full", "left_anti").select("path", "target")


def config(path: str, **placeholders: str) -> dict:
    """A JSON or YAML configuration with {NAME} replaced everywhere."""
    with open(path) as f:
        raw = f.read()
    if path.endswith(".json"):
        found = json.loads(raw)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML configurations need the yaml module") from e
        found = yaml.safe_load(raw)
    def fill(x):
        if isinstance(x, str):
            for k, v in placeholders.items():
                x = x.replace("{" + k + "}", v)
            return x
        return {k: fill(v) for k, v in x.items()} if isinstance(x, dict) else [fill(v) for v in x] if isinstance(x, list) else x

    return fill(found)


def override(settings: dict, pairs: list[str]) -> dict:
    """settings with "a.b=value" set, values read as JSON where they are."""
    for pair in pairs:
        where, _, value = pair.partition("=")
        *outer, last = where.split(".")
        at = settings
        for k in outer:
            at = at.setdefault(k, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return settings
