"""Queries on converters, on requests and their answers, and on JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants
from ..operators import converters, engine, evaluation, sampling, score, steps
from .q_eval import fit_sql
from .relations import EMBEDDED, embedded, read, u_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _flat_rows(spark: SparkSession, d: str) -> DataFrame:
    """documents as flat typed rows, some with faults."""
    docs = read(spark, d, "documents")
    i = F.col("doc_id")
    kind = F.when(i % 7 == 0, "odd").when(i % 5 == 0, "noul").otherwise("choice")
    target = F.when(i % 13 == 0, F.array(F.lit(0.0), F.lit(0.0))).when((i % 5 == 0) & (i % 2 == 0), F.array(F.lit(0.25))).otherwise(F.array(F.lit(0.5), F.lit(0.5)))
    return docs.select(
        i.cast("string").alias("id"), i.cast("string").alias("group_id"), "source", F.when(i % 11 == 0, "dev").otherwise("train").alias("split"), F.lit("mit").alias("license"), F.lit(None).cast("string").alias("license_use"),
        kind.alias("kind"), F.col("text").alias("state"), F.lit("which?").alias("question"), F.array(F.lit("a"), F.lit("b")).alias("options"), target.alias("target"), F.lit(None).cast("string").alias("variant"),
    )


def _rated_rows(spark: SparkSession, d: str) -> DataFrame:
    """orders as rated responses, some beyond the levels."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("row"), F.col("o_orderstatus").alias("prompt"), F.col("o_orderpriority").alias("response"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("helpfulness"), (k % 7).cast("int").alias("correctness"), (k % 5).cast("int").alias("coherence"), F.when(k % 3 > 0, 1).alias("complexity"), (F.year("o_orderdate") - 1992).cast("int").alias("verbosity"))


@query("""WITH f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'flat_split_column_mismatch' WHEN doc_id % 7 = 0 THEN 'unknown_kind' WHEN doc_id % 5 = 0 AND (doc_id % 13 = 0 OR doc_id % 2 = 1) THEN 'noul_bad_target' WHEN doc_id % 13 = 0 THEN 'empty_target' ELSE 'kept' END AS reason FROM documents),
r AS (SELECT unnest([substr(o_orderpriority, 1, 1)::INT - 1, o_orderkey % 7, o_orderkey % 5, CASE WHEN o_orderkey % 3 > 0 THEN 1 END, year(o_orderdate) - 1992]) AS v FROM orders)
SELECT 'flat' AS source, reason, count(*)::BIGINT AS n FROM f GROUP BY reason UNION ALL SELECT 'rated', CASE WHEN v BETWEEN 0 AND 4 THEN 'kept' ELSE 'rated_bad_rating' END, count(*)::BIGINT FROM r GROUP BY 2""")
def converter_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What two converters keep and drop, observed in the passes that read their decisions to the end."""
    sources = {"flat": {"converter": "flat", "dataset": "flat", "rows": _flat_rows(spark, d)}, "rated": {"converter": "ratings", "dataset": "rated", "index": "row", "rows": _rated_rows(spark, d)}}
    rows = []
    for name, s in sources.items():
        kept, seen, reasons = converters.converted(spark, s["converter"], s, "train")
        kept.write.format("noop").mode("overwrite").save()
        rows += converters.counted(name, seen, reasons)
    return spark.createDataFrame(rows, "source string, reason string, n long")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as requests: two questions on the first turn, some with a third of a type that isn't known."""
    first = read(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("state"), F.min_by("role", "turn").alias("role"))
    none = F.lit(None).cast("map<string,string>")
    one = lambda kind, text, criteria: F.struct(F.lit(kind).alias("type"), F.lit(text).alias("instructions"), criteria.alias("criteria"))
    asked = F.create_map(F.lit("polite"), one("noul", "Is it polite?", none), F.lit("who"), one("choice", "Who speaks?", F.create_map(F.lit("first"), F.col("role"), F.lit("other"), F.lit("nobody"))))
    odd = F.create_map(F.lit("odd"), one("rank", "x", none))
    return first.select(F.col("conv_id").cast("string").alias("id"), "state", F.when(F.col("conv_id") % 11 == 0, F.map_concat(asked, odd)).otherwise(asked).alias("questions"))


@query("""WITH f AS (SELECT conv_id, length(trim(coalesce(arg_min(text, turn), ''))) AS l, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id),
r AS (SELECT *, CASE WHEN l + 62 > 300 OR l + 63 + length(role) > 300 THEN 'prompt_too_long' WHEN conv_id % 11 = 0 THEN 'unsupported_type' END AS refusal,
 exp(length(role) / 20.0::DOUBLE) AS a, exp(6 / 20.0::DOUBLE) AS b, exp(0.3::DOUBLE) AS y, exp(0.2::DOUBLE) AS n FROM f)
SELECT conv_id::VARCHAR AS id, CASE WHEN refusal IS NULL THEN 'ok' ELSE 'unsupported' END AS status, refusal, (CASE WHEN conv_id % 11 = 0 THEN 3 ELSE 2 END)::BIGINT AS questions, (l + 63 + length(role))::BIGINT AS max_tokens,
 CASE WHEN refusal IS NULL THEN round(y / (y + n), 9) END AS polite, CASE WHEN refusal IS NULL THEN CASE WHEN a >= b THEN 'first' ELSE 'other' END END AS who, CASE WHEN refusal IS NULL THEN round(a / (a + b), 9) END AS first FROM r""")
def engine_answers(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered in three orders of their options, at a temperature of 2 for choices."""
    out = engine.answer(_requests(spark, d), score.length_scorer, max_len=300, temperatures={"choice": 2.0}, orders=3)
    who = F.try_element_at("answers", F.lit("who"))
    return out.select("id", "status", "refusal", "questions", "max_tokens", F.round(F.try_element_at("answers", F.lit("polite"))["noul"], 9).alias("polite"), who["choice"].alias("who"), F.round(F.get(who["probabilities"], F.lit(0)), 9).alias("first"))


_JSON = """concat('{"z": [1, 2.5, null], "a": "é\\\\"', event_type, '", "k": ', json_extract_string(props, '$.k'), '}')"""


@query(f"""SELECT event_id, concat('{{"z":[1,2.5,null],"a":"é\\"', event_type, '","k":', k, '}}') AS compact, concat('{{"a": "é\\"', event_type, '", "k": ', k, ', "z": [1, 2.5, null]}}') AS sorted, concat('{{"z": [1, 2.5, null], "a": "\\u00e9\\"', event_type, '", "k": ', k, '}}') AS plain, event_type AS text
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def json_written(spark: SparkSession, d: str) -> DataFrame:
    """Each event's JSON in the three styles, and a JSON string's own text."""
    e = read(spark, d, "events")
    text = F.concat(F.lit('{"z": [1, 2.5, null], "a": "é\\"'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return e.select("event_id", *(variants.written(text, s).alias(s) for s in variants.STYLES), variants.written(F.concat(F.lit('"'), "event_type", F.lit('"')), "compact").alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k=' || k WHEN event_id % 3 = 1 THEN '3={"k":null},' || CASE WHEN event_type = 'x' THEN '' ELSE event_type || '=' || k || ',x=2' END ELSE '' END AS entries
FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def json_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Objects, lists of objects and plain numbers as maps; of two objects of one key the later counts."""
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    listed = F.concat(F.lit('[{"id": "x", "k": 1}, 7, {"id": "'), "event_type", F.lit('", "k": '), "k", F.lit('}, {"k": null}, {"name": "x", "k": 2}]'))
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, listed).otherwise("5")
    entries = F.map_entries(variants.by_key(F.parse_json(text)))
    show = F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), F.coalesce(F.try_variant_get(x["value"], "$.k", "string"), F.try_variant_get(x["value"], "$", "string"), F.lit(""))))
    return e.select("event_id", F.array_join(F.array_sort(show), ",").alias("entries"))


@query("""SELECT event_type, count(*)::BIGINT AS n, 'OBJECT<k: ' || CASE WHEN event_type = 'error' THEN 'VARIANT' ELSE 'BIGINT' END || ', tags: ARRAY<STRING>' || CASE WHEN event_type = 'view' THEN ', v: DECIMAL(2,1)' ELSE '' END || '>' AS schema FROM events GROUP BY event_type""")
def json_schema(spark: SparkSession, d: str) -> DataFrame:
    """The schema of each event type's JSON, which for errors mixes numbers and texts."""
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    k = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.concat(F.lit('"'), "k", F.lit('"'))).otherwise(F.col("k"))
    text = F.concat(F.lit('{"k": '), k, F.lit(', "tags": ["a", "b"]'), F.when(F.col("event_type") == "view", ', "v": 1.5').otherwise(""), F.lit("}"))
    return variants.schema(e.select("event_type", F.parse_json(text).alias("v")), "v", ["event_type"])


@query("""WITH RECURSIVE s AS (SELECT event_type, event_id AS step, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, least(0.99::DOUBLE, (1 + event_id)::DOUBLE / (10 + event_id)) AS d FROM events WHERE value IS NOT NULL),
e AS (SELECT event_type, r, step, (1 - d) * value AS ema FROM s WHERE r = 1 UNION ALL SELECT s.event_type, s.r, s.step, s.d * e.ema + (1 - s.d) * s.value FROM e JOIN s ON s.event_type = e.event_type AND s.r = e.r + 1)
SELECT event_type, step, round(ema, 6) AS ema FROM e""")
def ema_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The running average of each event type's values, by compositions of affine maps."""
    e = read(spark, d, "events").select("event_type", F.col("event_id").alias("step"), "value")
    return steps.ema(e, "event_type", "step", "value", 0.99).withColumn("ema", F.round("ema", 6))


def _chain(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    """Two runs over embeddings as choices, one calibrated on half of the rows; labels are sources."""
    rows = embedded(spark, d).select(F.col("id").cast("string").alias("id"), "kind", "logits", "target", F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), F.lit("und").alias("language"))
    half = sampling.split_by(F.col("id"), 0.5, 3)
    calib, rest = (rows.where(c).withColumn("split", F.lit("validation")) for c in (half, ~half))
    fitted = evaluation.calibrate(calib)
    lost = rest.withColumn("logits", F.when(F.col("id").cast("long") % 10 > 0, F.col("logits")))
    return {"plain": evaluation.evaluate(rest), "calibrated": evaluation.evaluate(rest, fitted.temperatures), "lossy": evaluation.evaluate(lost)}, rows


def _side(name: str, rows: str, t: str) -> str:
    return f"""{name}_p AS (SELECT e.*, list_transform(logits, lambda x: exp((x - list_max(logits)) / {t})) AS ex FROM {rows} e), {name}_q AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM {name}_p),
{name}_m AS (SELECT source, kind, list_max(p) AS conf, (target[list_position(p, list_max(p))] >= list_max(target) - 1e-9)::INT::DOUBLE AS ok, -ln(least(greatest(list_inner_product(p, target), 1e-12), 1.0)) AS nll, list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - target[i]) * (p[i] - target[i]))) AS brier, greatest(1, ceil(list_max(p) * 15)) AS bin FROM {name}_q),
{name}_g AS (SELECT part, value, sum(n)::BIGINT AS n, sum(ok) / sum(n) AS acc, sum(nll) / sum(n) AS nll, sum(brier) / sum(n) AS brier, sum(conf) / sum(n) AS mean_conf, sum(abs(conf - ok)) / sum(n) AS ece FROM (
  SELECT part, value, bin, count(*) AS n, sum(ok) AS ok, sum(nll) AS nll, sum(brier) AS brier, sum(conf) AS conf FROM (SELECT unnest([['all', 'all'], ['kind', kind], ['source', source]]) AS x, x[1] AS part, x[2] AS value, * FROM {name}_m) GROUP BY part, value, bin) GROUP BY part, value),
{name}_r AS (SELECT part, value, n, acc, nll, brier, mean_conf, ece FROM {name}_g WHERE part <> 'source' OR value IN ('s1', 's4') UNION ALL
  SELECT k, '', sum(n)::BIGINT, sum(n * acc) / sum(n), sum(n * nll) / sum(n), sum(n * brier) / sum(n), sum(n * mean_conf) / sum(n), NULL FROM (SELECT unnest(CASE WHEN value IN ('s1', 's4') THEN ['selected', CASE WHEN value = 's4' THEN 'seen' ELSE 'not_flagged' END] ELSE ['not_flagged'] END) AS k, * FROM {name}_g WHERE part = 'source') GROUP BY k)"""


_COMPARED = f"""WITH {EMBEDDED}, everything AS (SELECT *, 's' || label AS source, {u_sql('id', 3)} < 0.5 AS calib FROM embedded), rest AS (SELECT * FROM everything WHERE NOT calib), fewer AS (SELECT * FROM rest WHERE id % 10 > 0),
{fit_sql('(SELECT * FROM everything WHERE calib)')}, {_side('a', 'rest', '1.0::DOUBLE')}, warm AS (SELECT rest.*, t FROM rest JOIN range3 USING (kind)), {_side('b', 'warm', 'e.t')}, {_side('c', 'fewer', '1.0::DOUBLE')},
u AS (SELECT 'plain' AS run, * FROM a_r UNION ALL SELECT 'calibrated', * FROM b_r UNION ALL SELECT 'lossy', * FROM c_r)"""


@query(f"""{_COMPARED} SELECT u.part, u.value, u.run, u.n, round(u.acc, 6) AS acc, round(u.nll, 4) AS nll, round(u.brier, 4) AS brier, round(u.mean_conf, 4) AS mean_conf, round(u.ece, 4) AS ece, CASE WHEN u.run <> 'plain' THEN round(100 * (u.acc - a_r.acc), 4) END AS gain
FROM u LEFT JOIN a_r ON a_r.part = u.part AND a_r.value = u.value""")
def runs_compared(spark: SparkSession, d: str) -> DataFrame:
    """Calibrate, evaluate, compare: three runs by group, over selected sources and by what an audit lists."""
    runs, rows = _chain(spark, d)
    names = rows.select("source").distinct()
    out = evaluation.compare(runs, "plain", names.where("source in ('s1', 's4')"), names.where("source = 's4'"))
    return out.select("part", "value", "run", "n", F.round("acc", 6).alias("acc"), *(F.round(c, 4).alias(c) for c in ("nll", "brier", "mean_conf", "ece", "gain")))
