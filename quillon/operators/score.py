"""Scoring: a scorer turns a batch of decisions into logits; batches are of like length, and a batch that is too large is halved."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: decisions (state, question, options) -> a list of logits for each; may raise MemoryError.
Scorer = Callable[[pd.DataFrame], list[list[float]]]


def uniform_scorer(rows: pd.DataFrame) -> list[list[float]]:
    return [[0.0] * len(o) for o in rows["options"]]


def hashed_scorer(rows: pd.DataFrame) -> list[list[float]]:
    """Logits by hashes of state, question and option: deterministic, and independent of the options' order."""
    one = lambda *x: int.from_bytes(hashlib.sha256("\x1f".join(x).encode()).digest()[:4], "big") / 2**31 - 1
    return [[one(s, q, o) for o in os_] for s, q, os_ in zip(rows["state"], rows["question"], rows["options"], strict=True)]


def length_scorer(rows: pd.DataFrame) -> list[list[float]]:
    """A tenth of each option's length: a scorer whose answers can be told beforehand."""
    return [[len(o) / 10 for o in os_] for os_ in rows["options"]]


def predict(df: DataFrame, scorer: Scorer, batch: int = 16, partitions: int | None = None) -> DataFrame:
    """(id, logits, status): status is ok, or unsupported where even a single row was too large."""
    def halved(rows: pd.DataFrame) -> list[tuple[list[float] | None, str]]:
        try:
            return [(x, "ok") for x in scorer(rows)]
        except MemoryError:
            if len(rows) == 1:
                return [(None, "unsupported")]
            mid = len(rows) // 2
            return halved(rows.iloc[:mid]) + halved(rows.iloc[mid:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [x for a in range(0, len(b), batch) for x in halved(b.iloc[a : a + batch])]
            yield pd.DataFrame({"id": b["id"].to_numpy(), "logits": [x for x, _ in out], "status": [s for _, s in out]})

    rows = df.select("id", "state", "question", "options").withColumn("size_", F.length("state"))
    rows = (rows.repartitionByRange(partitions, "size_") if partitions else rows.repartitionByRange("size_")).sortWithinPartitions("size_", "id").drop("size_")
    return rows.mapInPandas(run, "id string, logits array<double>, status string")
