"""Upstream rows to decisions, one function for each shape; what a row fails is a drop reason, not an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as ar
from ..functions import licenses, text as tx
from ..schema import make_decisions

#: Rated attributes and their questions, and the levels of a rating.
ATTRIBUTES = {
    "helpfulness": "How helpful is the response to the prompt?",
    "correctness": "How factually correct and complete is the response?",
    "coherence": "How coherent and clear is the response?",
    "complexity": "How complex is the writing (0 = basic language, 4 = expert-level)?",
    "verbosity": "How verbose is the response relative to what the prompt asks for (0 = very terse, 4 = very verbose)?",
}
LEVELS = ("0 (lowest)", "1", "2", "3", "4 (highest)")
MAX_DOCUMENT_CHARS = 600


def flat(df: DataFrame, split: str, dataset: str) -> DataFrame:
    """Flat typed rows (id, group_id, source, split, license, license_use, kind, state, question, options, target, variant): decisions with drop_reason."""
    wrong = F.coalesce(tx.norm_split(F.col("split")) != split, F.lit(False))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get("target", F.lit(0))))
    noul, score = F.col("kind") == "noul", F.col("kind") == "score"
    reason = F.when(wrong, f"{dataset}_split_column_mismatch").when(~F.coalesce(F.col("kind").isin("noul", "choice", "score"), F.lit(False)), "unknown_kind").when(noul & (F.size("target") != 1), "noul_bad_target")
    out = df.withColumn("drop_reason", reason).withColumn("target", F.when(noul, F.array(p, 1 - p)).otherwise(F.col("target")))
    out = out.withColumn("options", F.when(noul, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.col("options")))
    out = out.withColumn("option_values", F.when(score, F.transform("options", lambda _, i: i.cast("double"))))
    out = out.withColumn("license", licenses.tag_use(F.coalesce("license", F.lit("")), F.col("license_use"))).withColumns({"case_id": F.col("group_id"), "dataset": F.lit(dataset), "source": F.concat(F.lit(f"{dataset}/"), "source"), "split": F.lit(split), "language": F.lit("und")})
    return _finished(out, "empty_target")


def _finished(df: DataFrame, empty: str) -> DataFrame:
    made = make_decisions_keeping(df, ["drop_reason"])
    return made.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("target").isNull(), empty)))


def make_decisions_keeping(df: DataFrame, more: list[str]) -> DataFrame:
    """make_decisions, with further columns."""
    packed = df.withColumn("variant", F.to_json(F.struct(F.struct(*more).alias("more"), (F.col("variant") if "variant" in df.columns else F.lit(None).cast("string")).alias("variant"))))
    made = make_decisions(packed)
    kind = T.StructType([T.StructField("more", T.StructType([df.schema[c] for c in more])), T.StructField("variant", T.StringType())])
    opened = made.withColumn("v_", F.from_json("variant", kind))
    return opened.withColumn("variant", F.col("v_.variant")).select("*", *(F.col(f"v_.more.{c}").alias(c) for c in more)).drop("v_")


def tolerant_text(json: Column) -> Column:
    """A JSON string's text; other JSON and what isn't JSON as it stands."""
    return F.coalesce(F.get_json_object(F.concat(F.lit('{"x":'), F.when(json.rlike(r'^\s*".*"\s*$'), json), F.lit("}")), "$.x"), json)


def state_lines(entries: Column) -> Column:
    """A flat map as "key: value" lines."""
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


_QUESTION = "struct<type:string,instructions:string,criteria:string>"


def json_columns(df: DataFrame, dataset: str, split: str, licence: str = "apache-2.0") -> DataFrame:
    """Rows (id, workflow, state, questions, gold) whose last three are JSON: a decision for each question, with drop_reason. Gold is aligned by key, missing keys as 0."""
    q = df.select("*", F.explode(F.from_json("questions", f"map<string,{_QUESTION}>")).alias("name", "q"))
    q = q.withColumn("g", F.element_at(F.from_json("gold", "map<string,struct<probabilities:map<string,double>>>"), F.col("name")))
    q = q.withColumn("crit_", F.from_json("q.criteria", "map<string,string>")).withColumn("list_", F.from_json("q.criteria", "array<string>"))
    kind, probs = F.col("q.type"), F.col("g.probabilities")
    look = lambda k: F.coalesce(F.try_element_at(probs, k), F.lit(0.0))
    keys = F.map_keys("crit_")
    ok = ((kind == "score") & (F.size("list_") > 0)) | (kind == "noul") | ((kind == "choice") & (F.size(keys) > 0))
    reason = F.when(probs.isNull(), f"{dataset}_missing_gold").when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{dataset}_unsupported_type:"), F.coalesce(kind, F.lit("None"))))
    noul = F.when(F.col("crit_").isNotNull(), F.array(F.element_at("crit_", F.lit("true")), F.element_at("crit_", F.lit("false")))).otherwise(F.array(F.lit("yes"), F.lit("no")))
    out = q.withColumn("drop_reason", reason)
    out = out.withColumn("options", F.when(kind == "score", F.col("list_")).when(kind == "noul", noul).otherwise(F.transform(keys, lambda k: F.concat(k, F.lit(": "), F.element_at("crit_", k)))))
    out = out.withColumn("target", F.when(kind == "score", F.transform("list_", lambda _, i: look(i.cast("string")))).when(kind == "noul", F.array(look(F.lit("true")), look(F.lit("false")))).otherwise(F.transform(keys, look)))
    out = out.withColumn("option_values", F.when(kind == "score", F.transform("list_", lambda _, i: i.cast("double")))).withColumn("state", F.coalesce(state_lines(F.from_json("state", "map<string,string>")), F.col("state")))
    out = out.withColumns({"case_id": F.col("id"), "group_id": F.col("id"), "dataset": F.lit(dataset), "source": F.concat(F.lit(f"{dataset}/"), F.coalesce("workflow", F.lit("unknown"))), "split": F.lit(split), "language": F.lit("en"), "license": F.lit(licence), "kind": kind, "question": F.col("q.instructions")})
    out = out.withColumn("id", F.concat_ws(":", "id", "name"))
    return _finished(out, f"{dataset}_empty_target")


def ratings(df: DataFrame, dataset: str, split: str, index: str, upstream: str = "train", licence: str = "cc-by-4.0") -> DataFrame:
    """Rows of rated responses unpivoted to a decision for each attribute, the rating one-hot; others drop as bad ratings."""
    rows = df.select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("attr"), F.lit(q).alias("question"), F.col(a).cast("int").alias("v")) for a, q in ATTRIBUTES.items()))).alias("r")).select("*", "r.*").drop("r")
    rows = rows.withColumn("drop_reason", F.when(F.col("v").isNull() | ~F.col("v").between(0, 4), f"{dataset}_bad_rating"))
    case = F.concat_ws(":", F.lit(dataset), F.lit(upstream), F.col(index).cast("string"))
    rows = rows.withColumns({"id": F.concat_ws(":", case, "attr"), "case_id": case, "group_id": F.concat(F.lit(f"{dataset}:"), F.substring("prompt", 1, 200)), "dataset": F.lit(dataset), "source": F.concat(F.lit(f"{dataset}/"), "attr"), "split": F.lit(split), "language": F.lit("en"), "license": F.lit(licence), "kind": F.lit("score")})
    rows = rows.withColumn("state", F.concat(F.lit("Prompt:\n"), "prompt", F.lit("\n\nResponse:\n"), "response")).withColumn("options", F.array(*map(F.lit, LEVELS)))
    rows = rows.withColumn("target", ar.one_hot(F.col("v"), 5)).withColumn("option_values", F.array(*(F.lit(float(i)) for i in range(5))))
    return _finished(rows, f"{dataset}_empty_target")


def intents(df: DataFrame, locale: str, partition: str, n_options: int = 8, seed: int = 0) -> DataFrame:
    """Utterances (id, partition, intent, utt): the intent among others of the locale, drawn and put in order by hash. The locale's intents are a few dozen names."""
    names = df.select("intent").where("intent is not null").distinct().agg(F.array_sort(F.collect_list("intent")).alias("all_"))
    rows = df.where(F.col("partition") == partition).join(F.broadcast(names), how="cross")
    h = lambda x, what: F.sha2(F.concat_ws(":", F.lit(f"{seed}{what}"), F.col("id"), F.lit(locale), x), 256)
    others = F.filter("all_", lambda x: x != F.col("intent"))
    drawn = F.transform(F.slice(F.array_sort(F.transform(others, lambda x: F.struct(h(x, "d").alias("h"), x.alias("x")))), 1, n_options - 1), lambda s: s["x"])
    rows = rows.withColumn("drawn_", F.concat(drawn, F.array("intent")))
    rows = rows.withColumn("names_", F.transform(F.array_sort(F.transform("drawn_", lambda x: F.struct(h(x, "o").alias("h"), x.alias("x")))), lambda s: s["x"]))
    rows = rows.withColumn("target", F.transform("names_", lambda x: F.when(x == F.col("intent"), 1.0).otherwise(0.0))).withColumn("options", F.transform("names_", tx.humanise))
    rows = rows.withColumns({"case_id": F.concat_ws(":", F.lit(locale), "id"), "group_id": F.concat(F.lit("utt:"), F.col("id").cast("string")), "dataset": F.lit("intents"), "source": F.lit(f"intents/{locale}"), "split": F.lit({"dev": "validation"}.get(partition, partition)), "language": F.lit(locale.split("-")[0]), "license": F.lit("cc-by-4.0"), "kind": F.lit("choice"), "state": F.col("utt"), "question": F.lit("Which intent does the utterance have?"), "drop_reason": F.lit(None).cast("string")})
    rows = rows.withColumn("id", F.col("case_id"))
    return _finished(rows, "empty_target")


def nested(df: DataFrame, dataset: str, licence: str, split: str) -> DataFrame:
    """Rows with input.decisions[] and targets[]: targets meet decisions by id and options by theirs; scores are ordered by value; a ranking is a choice among documents cut to 600 characters."""
    rows = df.select("case_id", "group_id", "language", F.col("input.state_json").alias("state_json"), F.col("targets").alias("targets_"), F.explode("input.decisions").alias("d"))
    rows = rows.withColumn("t_", F.get(F.filter("targets_", lambda t: t["decision_id"] == F.col("d.id")), F.lit(0)))
    crit = F.size(F.coalesce("d.criteria", F.array().cast(df.schema["input"].dataType["decisions"].dataType.elementType["criteria"].dataType))) > 0
    docs = (F.size("d.documents") > 0) & (F.col("d.kind") == "ranking")
    one = lambda items, i: F.get(F.filter(items, lambda c: c["id"] == i), F.lit(0))
    kind = F.when(crit, F.col("d.type")).when(docs, "choice")
    places = F.transform(F.arrays_zip(F.col("t_.ids").alias("ids"), F.col("t_.probabilities").alias("ps")), lambda x, i: F.struct(
        F.when(kind == "score", one("d.criteria", x["ids"])["value"]).alias("v"), i.alias("i"), x["ps"].alias("p"),
        F.when(crit, tolerant_text(one("d.criteria", x["ids"])["description_json"])).otherwise(F.substring(tolerant_text(one("d.documents", x["ids"])["content_json"]), 1, MAX_DOCUMENT_CHARS)).alias("o")))
    rows = rows.withColumn("places_", F.when(kind == "score", F.array_sort(places)).otherwise(places))
    lost = F.exists("places_", lambda x: x["o"].isNull())
    reason = (
        F.when(F.col("t_").isNull(), f"{dataset}_no_target").when(~(crit | F.coalesce(docs, F.lit(False))), f"{dataset}_unsupported_shape").when(crit & lost, f"{dataset}_target_id_not_in_criteria")
        .when(crit & ~F.coalesce(kind.isin("choice", "noul", "score"), F.lit(False)), F.concat(F.lit(f"{dataset}_unsupported_type:"), F.coalesce(kind, F.lit("None")))).when((kind == "score") & F.exists("places_", lambda x: x["v"].isNull()), f"{dataset}_score_without_values").when(lost, f"{dataset}_target_id_not_in_documents")
    )
    rows = rows.withColumn("drop_reason", reason).withColumn("options", F.transform("places_", lambda x: x["o"])).withColumn("target", F.transform("places_", lambda x: x["p"])).withColumn("option_values", F.when(kind == "score", F.transform("places_", lambda x: x["v"].cast("double"))))
    rows = rows.withColumns({"id": F.concat_ws(":", F.lit(dataset), "case_id", "d.id"), "dataset": F.lit(dataset), "source": F.lit(dataset), "split": F.lit(split), "license": F.lit(licence), "kind": kind, "state": F.coalesce(state_lines(F.from_json("state_json", "map<string,string>")), tolerant_text(F.col("state_json"))), "question": tolerant_text(F.col("d.instructions_json"))})
    return _finished(rows, f"{dataset}_empty_target")


def requests(df: DataFrame) -> DataFrame:
    """Requests (id, state, questions: map of type, instructions, criteria): a decision with a uniform target for each question; status is ok or unsupported."""
    q = df.select("id", "state", F.explode("questions").alias("name", "q"))
    kind = F.col("q.type")
    q = q.withColumn("options", F.when(kind == "noul", F.array(F.lit("yes"), F.lit("no"))).otherwise(F.map_values("q.criteria")))
    ok = F.coalesce(kind.isin("noul", "choice", "score") & (F.size("options") > 1), F.lit(False))
    return q.select("id", "name", "state", F.col("q.instructions").alias("question"), kind.alias("kind"), "options", F.when(ok, ar.uniform_over(F.col("options"))).alias("target"), F.when(ok, "ok").otherwise("unsupported").alias("status"))


def subset_licences(upstreams: DataFrame, accept_qualified: bool = False) -> DataFrame:
    """(subset, allowed, reason, licenses) from (subset, place, license, status): every upstream must pass and be verified; the first failure by place is the reason."""
    why = licenses.reason(F.col("license"))
    why = F.when(licenses.allowed(why) & F.lit(not accept_qualified) & ~F.coalesce(F.col("status") == "verified", F.lit(False)), F.concat(F.lit("license_"), F.coalesce("status", F.lit("unreviewed")))).otherwise(why)
    failed = ~licenses.allowed(F.col("why"))
    grouped = upstreams.withColumn("why", why).groupBy("subset").agg(F.min_by(F.when(failed, F.col("why")), F.when(failed, F.col("place"))).alias("first"), F.array_join(F.array_sort(F.collect_set(F.coalesce("license", F.lit("")))), "; ").alias("licenses"))
    return grouped.select("subset", F.col("first").isNull().alias("allowed"), F.coalesce("first", F.lit("ok")).alias("reason"), "licenses")
