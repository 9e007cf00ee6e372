"""Requests answered by a scorer: each question of a request becomes a decision, all are scored in Arrow batches, and the answers come together again by request.

A request is answered whole or refused whole, with the reason of its first question that has one: nothing is cut to fit.
Options can be shown in several orders; their logits go back to the options' own order and are averaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as ar
from . import render, score

#: A question of a request.
QUESTION = "struct<type:string,instructions:string,criteria:map<string,string>>"


def questions(requests: DataFrame) -> DataFrame:
    """requests (id, state, questions: map of names to QUESTION) to a row a question: id, place, name, state, kind, question, keys, options."""
    q = requests.select("id", "state", F.posexplode(F.map_entries("questions")).alias("place", "e"))
    kind, criteria = F.col("e.value.type"), F.col("e.value.criteria")
    yes_no = F.array(F.lit("yes"), F.lit("no"))
    keys = F.when(kind == "noul", yes_no).when(kind == "choice", F.map_keys(criteria))
    options = F.when(kind == "noul", yes_no).when(kind == "choice", F.map_values(criteria))
    return q.select("id", "place", F.col("e.key").alias("name"), "state", kind.alias("kind"), F.coalesce("e.value.instructions", F.lit("")).alias("question"), keys.alias("keys"), options.alias("options"))


def judged(asked: DataFrame, mode: str = "slot", tok=render.code_points, max_len: int = 2048, max_option: int = 1024) -> DataFrame:
    """questions with tokens (of the whole prompt) and refusal: unsupported_type, no_options, too_many_options, option_too_long, prompt_too_long or null."""
    shown = {"slot": lambda o, i: F.concat(F.lit(" "), o, F.lit("\n")), "letter": lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o, F.lit("\n"))}.get(mode, lambda o, i: o)
    known = F.coalesce(F.col("kind").isin("noul", "choice"), F.lit(False))
    some = F.coalesce(F.size("options") > 0, F.lit(False))
    rendered = render.render(asked.withColumn("options", F.coalesce("options", F.array(F.lit("")))).withColumn("state", F.coalesce("state", F.lit(""))), mode, tok, 1 << 30, max_option=max_option)
    tokens = F.size("input_ids")
    long = F.exists(F.transform("options", lambda o, i: F.size(tok(shown(o, i)))), lambda n: n > max_option)
    refusal = (
        F.when(~known, "unsupported_type").when(~some, "no_options").when(F.lit(mode == "letter") & (F.size("options") > render.LETTERS), "too_many_options").when(long, "option_too_long")
        .when((F.col("status") != "ok") | (tokens > max_len), "prompt_too_long")
    )
    return rendered.withColumn("some_", some).withColumn("refusal", refusal).withColumn("tokens", tokens.cast("long")).select(*asked.columns, "tokens", "refusal")


def _at(temperatures: dict[str, float] | None) -> Column:
    """The temperature of a row's kind."""
    return F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(t))) for k, t in (temperatures or {}).items()), F.lit(1.0))


def answer(requests: DataFrame, scorer: score.Scorer, mode: str = "slot", tok=render.code_points, max_len: int = 2048, max_option: int = 1024, temperatures: dict[str, float] | None = None, orders: int = 0, batch: int = 16) -> DataFrame:
    """(id, status, refusal, questions, max_tokens, answers: map of names to (type, choice, noul, keys, probabilities)).

    orders: in how many hashed orders of the options each question is asked; 0 asks it once, as it stands. A question that
    the scorer has no memory for, alone in its batch, refuses its request (out_of_memory), and so does a probability that isn't finite.
    """
    asked = judged(questions(requests), mode, tok, max_len, max_option)
    verdicts = asked.groupBy("id").agg(F.min_by("refusal", F.when(F.col("refusal").isNotNull(), F.col("place"))).alias("first"), F.max("tokens").alias("max_tokens"), F.count("*").alias("questions"))
    key = F.concat_ws("\x1f", "id", F.col("place").cast("string"))
    fit = asked.join(verdicts.where("first is null").select("id"), "id", "left_semi").withColumn("key", key)
    turn = F.explode(F.sequence(F.lit(0), F.lit(max(orders, 1) - 1)))
    shown = fit.select("key", "kind", "state", "question", "options", turn.alias("turn"))
    plain = F.sequence(F.lit(0), F.size("options") - 1)
    order = F.coalesce(*(F.when(F.col("turn") == t, render.permutation(F.col("key"), F.col("kind"), F.col("options"), t)) for t in range(orders)), plain)
    shown = shown.withColumn("order", order).withColumn("options", F.transform("order", lambda i: F.get("options", i))).withColumn("id", F.concat_ws("\x1e", "key", F.col("turn").cast("string")))
    scored = score.predict(shown.select("id", "state", "question", "options"), scorer, batch).join(shown.select("id", "key", "order"), "id")
    each = scored.select("key", "status", F.posexplode_outer(ar.unpermute(F.col("logits"), F.col("order"))).alias("at", "x"))
    means = each.groupBy("key", "at").agg(F.avg("x").alias("x"), F.max(F.col("status") != "ok").alias("failed"))
    logits = means.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("logits"), F.max("failed").alias("failed"))
    p = ar.softmax(F.transform("logits", lambda x: x / F.col("t_")), 1.0)
    found = fit.join(logits, "key").withColumn("t_", _at(temperatures)).withColumn("p", F.when(~F.col("failed"), p))
    bad = F.when(F.col("failed"), "out_of_memory").when(F.exists("p", lambda x: x.isNull() | F.isnan(x)), "not_finite")
    noul = F.col("kind") == "noul"
    one = F.struct(F.col("kind").alias("type"), F.when(~noul, F.get("keys", F.array_position("p", F.array_max("p")).cast("int") - 1)).alias("choice"), F.when(noul, F.get("p", F.lit(0))).alias("noul"), F.when(~noul, F.col("keys")).alias("keys"), F.when(~noul, F.col("p")).alias("probabilities"))
    together = found.groupBy("id").agg(F.min_by(bad, F.when(bad.isNotNull(), F.col("place"))).alias("bad"), F.array_sort(F.collect_list(F.struct("place", "name", one.alias("a")))).alias("all_"))
    answers = F.map_from_entries(F.transform("all_", lambda x: F.struct(x["name"], x["a"])))
    out = requests.select("id").join(verdicts, "id", "left").join(together, "id", "left")
    refusal = F.coalesce("first", "bad", F.when(F.col("questions").isNull(), "no_questions"))
    return out.select("id", F.when(refusal.isNull(), "ok").otherwise("unsupported").alias("status"), refusal.alias("refusal"), F.coalesce("questions", F.lit(0)).alias("questions"), "max_tokens", F.when(refusal.isNull(), answers).alias("answers"))
