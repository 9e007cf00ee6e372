"""Commands: python -m quillon COMMAND ... Each reads and writes tables that Spark names, and prints a small report as JSON.

  build      the mixture of a configuration: decisions in, train, validation, calib, heldout and test out, as one snapshot
  calibrate  temperatures from predictions (kind, split, logits, target)
  evaluate   metrics by group of predictions (also id, source, language), with temperatures if there are any
  compare    evaluated runs side by side
  report     shares and diversity of a table of decisions
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, mixture, report, selection
from .schema import KINDS
from .sources import readers, writers


def settings(config: dict) -> mixture.Settings:
    """A build's settings from a configuration's section ``build``; its ``sizes`` are a section of their own. Unknown names are an error."""
    own = dict(config.get("build") or {})
    for kind, given in ((mixture.Settings, own), (selection.Sizes, own.get("sizes") or {})):
        if unknown := set(given) - {f.name for f in dataclasses.fields(kind)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if own.get("sizes"):
        own["sizes"] = selection.Sizes(**own["sizes"])
    own["excluded"] = mixture.exclusions({"exclude_sources": own.get("excluded")}, config.get("others") or [])
    return mixture.Settings(**own)


def _json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    config = readers.override(readers.config(a.config, **dict(p.split("=", 1) for p in a.root)), a.set)
    rows = readers.decisions(spark, config["decisions"]).withColumn("seq", F.concat_ws("\x1f", F.col("_metadata.file_path"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0")))
    s = settings(config)
    built = mixture.build(rows.where("split = 'train'"), rows.where("split <> 'train'"), s)
    snapshot = writers.Snapshot(spark, config["output"])
    stored = {k: snapshot.table(k, v.drop("seq")) for k, v in built.items() if k.startswith("train") or k in ("validation", "calib", "heldout", "test")}
    mixture.check(stored)
    solved = built.get("solved")
    return snapshot.commit(config=config, drops=built["ledger"], solved=dataclasses.asdict(solved) if solved else None, leakage="passed")


def calibrate(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = evaluation.calibrate(spark.read.parquet(a.predictions), KINDS)
    out = {"temperatures": found.temperatures, **found.summary}
    writers.text_file(spark, a.output, json.dumps(out, indent=1))
    return out


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    temperatures = _json(spark, a.calibration)["temperatures"] if a.calibration else None
    results = evaluation.evaluate(spark.read.parquet(a.predictions), temperatures, a.split, a.final)
    results.write.mode("overwrite").parquet(a.output)
    if a.split == "test":
        writers.append_log(spark.range(1).select(F.current_timestamp().alias("time"), F.lit(a.predictions).alias("predictions"), F.lit(temperatures is not None).alias("calibrated")), f"{a.output.rstrip('/')}-access")
    return {"all": _rows(spark.read.parquet(a.output).where("group_type in ('all', 'kind')")), "calibrated": temperatures is not None}


def compare(spark: SparkSession, a: argparse.Namespace) -> dict:
    runs = {p.rstrip("/").rsplit("/", 1)[-1]: spark.read.parquet(p) for p in a.runs}
    some = lambda path: spark.read.text(path).select(F.trim("value").alias("source")).where("source <> ''") if path else None
    out = evaluation.compare(runs, next(iter(runs)), some(a.sources), some(a.seen)).orderBy("part", "value", "run")
    print(writers.markdown(out, 3))
    return {"runs": list(runs), "rows": out.count()}


def reported(spark: SparkSession, a: argparse.Namespace) -> dict:
    df = readers.decisions(spark, a.decisions)
    return {"diversity": _rows(report.diversity(df)), "sources": _rows(report.effective_sources(df)), "shares": _rows(report.diversity_shares(df, ["dataset", "kind", "language"]).orderBy("field", F.col("n").desc(), "value"))}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("quillon", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, *args, name=None):
        c = sub.add_parser(name or run.__name__)
        for flags, options in args:
            c.add_argument(flags, **options)
        c.set_defaults(run=run)

    command(build, ("--config", {"required": True}), ("--set", {"nargs": "*", "default": [], "help": "a.b=value"}), ("--root", {"nargs": "*", "default": [], "help": "NAME=value, for {NAME} in the configuration"}))
    command(calibrate, ("predictions", {}), ("output", {}))
    command(evaluate, ("predictions", {}), ("output", {}), ("--calibration", {}), ("--split", {"default": "validation"}), ("--final", {"action": "store_true"}))
    command(compare, ("runs", {"nargs": "+"}), ("--sources", {}), ("--seen", {}))
    command(reported, ("decisions", {}), name="report")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"quillon {a.command}").getOrCreate()
    print(json.dumps(a.run(spark, a), indent=1, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
