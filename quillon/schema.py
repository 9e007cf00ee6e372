"""The Decision record: a state, a question, options and a target distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import arrays

KINDS = ("noul", "choice", "score")
SPLITS = ("train", "validation", "test")

_S, _D = T.StringType(), T.ArrayType(T.DoubleType())
DECISION = T.StructType(
    [T.StructField(c, _S) for c in ("id", "case_id", "group_id", "dataset", "source", "split", "language", "license", "kind", "state", "question")]
    + [T.StructField("options", T.ArrayType(_S)), T.StructField("target", _D), T.StructField("option_values", _D), T.StructField("soft", T.BooleanType()), T.StructField("variant", _S)]
)


def invalid(target_tolerance: float = 1e-4) -> Column:
    """Why a decision is invalid, by the first rule it breaks; null if it is valid."""
    n, c = F.size("options"), F.col
    rules = (
        (~c("kind").isin(*KINDS) | c("kind").isNull(), "bad_kind"),
        (~c("split").isin(*SPLITS) | c("split").isNull(), "bad_split"),
        (F.coalesce(n, F.lit(-1)) < 2, "lt2_options"),
        (F.coalesce(F.size("target"), F.lit(-1)) != n, "target_len_mismatch"),
        (F.exists("target", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)), "bad_target_value"),
        (F.abs(arrays.total(c("target")) - 1) > target_tolerance, "target_not_normalised"),
        (c("option_values").isNotNull() & (F.size("option_values") != n), "option_values_mismatch"),
        ((F.trim(F.coalesce(c("state"), F.lit(""))) == "") | (F.trim(F.coalesce(c("question"), F.lit(""))) == ""), "empty_text"),
        (F.exists("options", lambda o: o.isNull() | (F.trim(o) == "")), "empty_option"),
    )
    return F.coalesce(*(F.when(bad, F.lit(why)) for bad, why in rules))


def make_decisions(df: DataFrame) -> DataFrame:
    """df with the columns of a decision, target normalised and soft derived; rows without mass are dropped by reading ``target is not null``."""
    for f in DECISION.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    df = df.withColumn("target", arrays.normalise(F.col("target").cast("array<double>"))).withColumn("options", F.col("options").cast("array<string>"))
    return df.withColumn("soft", F.coalesce(arrays.is_soft(F.col("target")), F.lit(False))).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in DECISION.fields))
