"""The corpus pipeline: quality rules, line dedup, near-duplicate join, mixing and piece encoding, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, which may
have any names. Null and empty texts fail the quality rules; repeated rows go in near_duplicates but for one; an empty
table stays empty through all stages; a text of any length is worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import jaccard, line_chunks, mixing, pieces, quality
from quillon.llm.common import table, written
from quillon.llm.queries import vocabulary_file


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated chunks of lines but for their first place."""
    return line_chunks.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return jaccard.keep_one(docs, shingle=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, range-sorted by training position: written, their files by name are in that order, which the reading of the next stage doesn't keep."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids."""
    return pieces.encode(docs, vocabulary_file("piece_bpe_32k.model"))


STAGES = [("quality", rules), ("line_dedup", lines), ("near_duplicates", near), ("mix", mix), ("pieces", encode)]

#: The quality trees, components over whole texts and piece search aren't SQL. Tests compare operators with brute force, not the rows of the stages or of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
