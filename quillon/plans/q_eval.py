"""Queries on metrics, novelty, reports, rendering and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx
from ..operators import guard, metrics, novelty, render, report, sampling
from .q_data import GUARD, QUERIES as _DATA, benchmark_as_eval, documents_as_train, flagged
from .relations import EMBEDDED, LABELLED, MEASURED, ORDERED, PREDICTED, labelled, ordered, predicted, read, u_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def measured(spark: SparkSession, d: str) -> DataFrame:
    return metrics.row_metrics(predicted(spark, d))


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {PREDICTED} SELECT id, list_position(p, list_max(p))::BIGINT - 1 AS top, round(list_max(p), 6) AS conf FROM predicted")
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    return predicted(spark, d).select("id", ar.argmax(F.col("p")).cast("long").alias("top"), F.round(F.array_max("p"), 6).alias("conf"))


@query(f"WITH {MEASURED} SELECT id, round(conf, 6) AS conf, correct, acc, round(nll, 6) AS nll, round(brier, 6) AS brier, round(kl, 6) AS kl FROM measured")
def row_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r6(measured(spark, d), "conf", "nll", "brier", "kl").select("id", "conf", "correct", "acc", "nll", "brier", "kl")


_BINNED = MEASURED + ", binned AS (SELECT *, greatest(ceil(conf * 15), 1)::BIGINT AS bin FROM measured)"


@query(f"""WITH {_BINNED}, per AS (SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'all' END AS group_type, coalesce(label::VARCHAR, kind, 'all') AS group_value, bin, count(*) AS n, sum(conf) AS c, sum(correct) AS k, sum(nll) AS nll, sum(brier) AS brier, sum(kl) AS kl FROM binned GROUP BY GROUPING SETS ((bin), (kind, bin), (label, bin)))
SELECT group_type, group_value, sum(n)::BIGINT AS n, round(sum(k) / sum(n), 6) AS acc, round(sum(nll) / sum(n), 6) AS nll, round(sum(brier) / sum(n), 6) AS brier, round(sum(kl) / sum(n), 6) AS kl, round(sum(c) / sum(n), 6) AS mean_conf, round(sum(abs(c - k)) / sum(n), 6) AS ece FROM per GROUP BY 1, 2""")
def group_metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.by_groups(measured(spark, d), [[], ["kind"], ["label"]]), "acc", "nll", "brier", "kl", "mean_conf", "ece")


@query(f"WITH {_BINNED}, per AS (SELECT bin, count(*) AS n, sum(conf) AS c, sum(correct) AS k FROM binned GROUP BY bin) SELECT round(sum(abs(c - k)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM per")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_groups(measured(spark, d), [[]]).select(F.round("ece", 6).alias("ece"), "n")


@query(f"WITH {_BINNED} SELECT bin, count(*)::BIGINT AS n, round(avg(conf), 4) AS mean_conf, round(avg(correct), 4) AS mean_acc FROM binned GROUP BY bin")
def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reliability(measured(spark, d)).withColumns({"mean_conf": F.round("mean_conf", 4), "mean_acc": F.round("mean_acc", 4)})


@query(f"WITH {MEASURED}, r AS (SELECT correct, row_number() OVER (ORDER BY conf DESC, id) AS r, count(*) OVER () AS n FROM measured), c AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS coverage), k AS (SELECT coverage, greatest(1, round_even(coverage * (SELECT count(*) FROM r), 0))::BIGINT AS k FROM c) SELECT coverage, k, round((SELECT avg(1 - correct) FROM r WHERE r.r <= k.k), 6) AS risk FROM k")
def selective_risk(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.selective_risk(measured(spark, d)), "risk")


@query(f"WITH {ORDERED}, e AS (SELECT id, level, list_inner_product(p, option_values) AS e FROM ordered), r AS (SELECT row_number() OVER (ORDER BY round(e, 9), id) AS a, row_number() OVER (ORDER BY level, id) AS b FROM e) SELECT round(corr(a, b), 6) AS spearman, count(*)::BIGINT AS n FROM r")
def spearman_ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows = ordered(spark, d).select("id", F.round(ar.expected(F.col("p"), F.col("option_values")), 9).alias("e"), "level")
    return r6(metrics.spearman(rows, "e", "level", "id"), "spearman")


@query(f"WITH {ORDERED} SELECT round(avg(abs(list_inner_product(p, option_values) - list_inner_product(target, option_values))), 6) AS mae, count(*)::BIGINT AS n FROM ordered")
def score_mae(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.score_mae(ordered(spark, d)), "mae")


@query(f"WITH {ORDERED} SELECT id, round(list_sum(list_transform(range(1, 6), lambda i: (list_sum(p[1:i]) - list_sum(target[1:i])) * (list_sum(p[1:i]) - list_sum(target[1:i])))), 6) AS emd2 FROM ordered")
def emd2(spark: SparkSession, d: str) -> DataFrame:
    return ordered(spark, d).select("id", F.round(ar.emd2(F.col("p"), F.col("target")), 6).alias("emd2"))


_GRID = [0.5, 0.8, 1.0, 1.3, 1.6, 2.0, 3.0, 5.0]


@query(f"""WITH {PREDICTED}, g AS (SELECT *, list_max(logits) AS m FROM embedded, (SELECT unnest({_GRID}::DOUBLE[]) AS t)), e AS (SELECT *, list_transform(logits, lambda x: exp((x - m) / t)) AS ex FROM g)
SELECT kind, t, round(avg(-ln(least(greatest(ex[label + 1] / list_sum(ex), 1e-12), 1.0))), 6) AS nll FROM e GROUP BY kind, t""")
def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.temperature_grid(predicted(spark, d), grid=_GRID), "nll")


def fit_sql(rows: str = "embedded", rounds: int = 3) -> str:
    """Common tables range{i} (kind, low, high, t): the best of 25 temperatures between low and high, and the next round's range around it."""
    out = [f"range0 AS (SELECT DISTINCT kind, 0.05::DOUBLE AS low, 20.0::DOUBLE AS high, NULL::DOUBLE AS t FROM {rows})"]
    for i in range(rounds):
        out.append(f"""probe{i} AS (SELECT r.kind, r.low, r.high, r.low * pow(r.high / r.low, k / 24.0::DOUBLE) AS t FROM range{i} r, unnest(range(0, 25)) AS u(k)),
exps{i} AS (SELECT p.*, e.target, list_transform(e.logits, lambda x: exp((x - list_max(e.logits)) / p.t)) AS ex FROM probe{i} p JOIN {rows} e USING (kind)),
nll{i} AS (SELECT kind, low, high, t, avg(-ln(least(greatest(list_inner_product(ex, target) / list_sum(ex), 1e-12), 1.0))) AS nll FROM exps{i} GROUP BY ALL),
best{i} AS (SELECT kind, any_value(low) AS low, any_value(high) AS high, arg_min(t, nll) AS t FROM nll{i} GROUP BY kind),
range{i + 1} AS (SELECT kind, greatest(0.05, t / pow(high / low, 1 / 24.0::DOUBLE)) AS low, least(20.0, t * pow(high / low, 1 / 24.0::DOUBLE)) AS high, t FROM best{i})""")
    return ",\n".join(out)


@query(f"WITH {EMBEDDED}, {fit_sql()} SELECT kind, round(t, 6) AS temperature FROM range3 UNION ALL SELECT 'noul', 1.0::DOUBLE")
def fitted_temperature(spark: SparkSession, d: str) -> DataFrame:
    fitted = metrics.fit_temperatures(predicted(spark, d).select("kind", "logits", "target"), ["choice", "noul"])
    return r6(spark.createDataFrame(sorted(fitted.items()), "kind string, temperature double"), "temperature")



_REFERENCE = "round(avg((list_position(q, list_max(q)) = list_position(target, list_max(target)))::INT::DOUBLE), 6) AS acc, round(avg(list_sum(list_transform(range(1, 6), lambda i: (q[i] - target[i]) * (q[i] - target[i])))), 6) AS brier, round(avg(-ln(greatest(q[level + 1], 1e-12))), 6) AS kl, count(*)::BIGINT AS n"


def _reference(df: DataFrame) -> DataFrame:
    m = metrics.row_metrics(df, "q")
    return r6(m.groupBy("workflow").agg(F.avg("acc").alias("acc"), F.avg("brier").alias("brier"), F.avg("kl").alias("kl"), F.count("*").alias("n")), "acc", "brier", "kl")


@query(f"WITH {ORDERED} SELECT workflow, {_REFERENCE} FROM (SELECT *, p AS q FROM ordered) GROUP BY workflow")
def prior_reference(spark: SparkSession, d: str) -> DataFrame:
    return _reference(ordered(spark, d).withColumn("q", F.col("p")))


@query(f"WITH {ORDERED} SELECT workflow, {_REFERENCE} FROM (SELECT *, [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[] AS q FROM ordered) GROUP BY workflow")
def uniform_reference(spark: SparkSession, d: str) -> DataFrame:
    return _reference(ordered(spark, d).withColumn("q", ar.uniform_over(F.col("target"))))


_RESULTS = "results AS (SELECT CASE label % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS run, label, count(*) AS n, avg(correct) AS acc, avg(nll) AS nll, avg(brier) AS brier, CASE WHEN label = 3 THEN NULL ELSE avg(conf) END AS mean_conf FROM measured GROUP BY label)"
_POOLED = "pooled AS (SELECT run, sum(n) AS n, sum(n * acc) / sum(n) AS acc, sum(n * nll) / sum(n) AS nll, sum(n * brier) / sum(n) AS brier, CASE WHEN count(*) = count(mean_conf) THEN sum(n * mean_conf) / sum(n) END AS mean_conf FROM results GROUP BY run)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    per = measured(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.avg("correct").alias("acc"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("conf").alias("c"))
    return per.select(F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("run"), "label", "n", "acc", "nll", "brier", F.when(F.col("label") != 3, F.col("c")).alias("mean_conf"))


@query(f"WITH {MEASURED}, {_RESULTS}, {_POOLED} SELECT run, n::BIGINT AS n, round(acc, 6) AS acc, round(nll, 6) AS nll, round(brier, 6) AS brier, round(mean_conf, 6) AS mean_conf FROM pooled")
def pooled_metrics(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.pooled(_results(spark, d), ["run"]), "acc", "nll", "brier", "mean_conf")


@query(f"WITH {MEASURED}, {_RESULTS}, {_POOLED} SELECT run, round(100 * (acc - (SELECT acc FROM pooled WHERE run = 'even')), 6) AS gain FROM pooled")
def gain_vs_reference(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.gain(metrics.pooled(_results(spark, d), ["run"]), "run", "even"), "gain").select("run", "gain")


@query("""WITH base AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0.8 ELSE 0.3 END::DOUBLE AS t, o_orderkey % 11 = 0 AS gone, o_orderkey % 7 = 0 AS odd FROM orders)
SELECT CASE WHEN gone THEN 'no_prediction' WHEN odd THEN 'no_key' ELSE 'ok' END AS status, count(*)::BIGINT AS n, round(sum(CASE WHEN NOT gone AND NOT odd THEN t / (t + 0.4) END), 4) AS mass FROM base GROUP BY 1""")
def external_predictions(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 0.8).otherwise(0.3).alias("t"))
    decisions = o.select("id", F.array(F.lit("true"), F.lit("false")).alias("keys"))
    given = o.where("id % 11 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.create_map(F.lit("maybe"), F.col("t"))).otherwise(F.create_map(F.lit("Yes"), F.col("t"), F.lit("no"), F.lit(0.4))).alias("probs"))
    out = metrics.align_external(decisions, given)
    return out.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(F.get("p", F.lit(0))), 4).alias("mass"))


_SETS = """rows AS (SELECT p_partkey AS id, p_brand AS source, CASE WHEN p_size % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN p_brand < 'Brand#2' THEN [lower(p_brand), 'b'] WHEN p_size < 25 THEN ['yes', 'no'] ELSE [lower(p_type), lower(p_brand)] END AS options FROM part),
stats AS (SELECT source, array_to_string(list_sort(list_distinct(options)), chr(31)) AS "set", count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train, max(len(options)) AS k FROM rows GROUP BY 1, 2),
seen AS (SELECT *, (SELECT count(*) FROM stats o WHERE o."set" = s."set" AND o.source <> s.source AND o.n_train > 0) > 0 AS others FROM stats s),
strs AS (SELECT source, s, max(n_train) > 0 AS t FROM (SELECT source, unnest(string_split("set", chr(31))) AS s, n_train FROM stats) GROUP BY 1, 2),
over_ AS (SELECT a.source, avg((EXISTS (SELECT 1 FROM strs b WHERE b.s = a.s AND b.source <> a.source AND b.t))::INT::DOUBLE) AS string_overlap FROM strs a GROUP BY a.source),
scores AS (SELECT source, sum(n) AS n, sum(n_train) AS n_train, sum(n - n_train) AS n_eval, count(*) AS sets, sum(CASE WHEN n >= 20 THEN n ELSE 0 END)::DOUBLE / sum(n) AS repeat_fraction, sum(CASE WHEN others THEN n ELSE 0 END)::DOUBLE / sum(n) AS seen_fraction, any_value(string_overlap) AS string_overlap FROM seen JOIN over_ USING (source) GROUP BY source)"""


def _labels_rows(spark: SparkSession, d: str) -> DataFrame:
    brand = F.lower("p_brand")
    options = F.when(F.col("p_brand") < "Brand#2", F.array(brand, F.lit("b"))).when(F.col("p_size") < 25, F.array(F.lit("yes"), F.lit("no"))).otherwise(F.array(F.lower("p_type"), brand))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("source"), F.when(F.col("p_size") % 4 == 0, "test").otherwise("train").alias("split"), options.alias("options"))


@query(f'WITH {_SETS} SELECT source, sha256("set") AS h, n::BIGINT AS n, n_train::BIGINT AS n_train, k::BIGINT AS k FROM stats')
def option_set_stats(spark: SparkSession, d: str) -> DataFrame:
    return novelty.set_stats(_labels_rows(spark, d)).select("source", F.sha2("set", 256).alias("h"), "n", "n_train", "k")


@query(f"WITH {_SETS} SELECT source, n::BIGINT AS n, n_train::BIGINT AS n_train, n_eval::BIGINT AS n_eval, sets::BIGINT AS sets, round(repeat_fraction, 6) AS repeat_fraction, round(seen_fraction, 6) AS seen_fraction, round(string_overlap, 6) AS string_overlap FROM scores")
def label_novelty(spark: SparkSession, d: str) -> DataFrame:
    return r6(novelty.source_scores(novelty.set_stats(_labels_rows(spark, d))), "repeat_fraction", "seen_fraction", "string_overlap")


@query(f"WITH {_SETS} SELECT coalesce(CASE WHEN n_train < 50 THEN 'n_train' WHEN n_eval < 18 THEN 'n_eval' WHEN repeat_fraction < 0.5 THEN 'repeat_fraction' WHEN seen_fraction > 0.1 THEN 'seen_fraction' WHEN string_overlap > 0.3 THEN 'string_overlap' END, 'eligible') AS reason, count(*)::BIGINT AS n FROM scores GROUP BY 1")
def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    scores = novelty.source_scores(novelty.set_stats(_labels_rows(spark, d)))
    return scores.groupBy(F.coalesce(novelty.ineligible({"min_train": 50, "min_eval": 18}), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(f'WITH {_SETS}, ks AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k, "set") - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM stats) SELECT source, k::BIGINT AS median FROM ks WHERE r = n // 2')
def upper_median_options(spark: SparkSession, d: str) -> DataFrame:
    return novelty.upper_median(novelty.set_stats(_labels_rows(spark, d)), ["source"], "k")


_NAMES = "cand AS (SELECT DISTINCT 'x/' || replace(p_name, ' ', '/') AS name FROM part), tr AS (SELECT DISTINCT 'y/' || n_name || '/' || r_name AS trained FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT 't/' || split_part(p_name, ' ', 1) || 'ish' FROM part)"


@query("""WITH cand AS (SELECT DISTINCT 'x/' || event_type || '_task' AS name FROM events UNION SELECT DISTINCT 'x/' || source FROM documents), tr AS (SELECT DISTINCT 'y/' || event_type AS trained FROM events UNION SELECT DISTINCT 'z/' || lang || '/' || source FROM documents WHERE source < 'src2'),
a AS (SELECT name, p FROM (SELECT name, unnest(list_filter(list_transform(string_split(lower(name), '/')[2:], lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')), lambda x: length(x) >= 3)) AS p FROM cand)),
b AS (SELECT trained, q FROM (SELECT trained, unnest(list_filter(list_transform(string_split(lower(trained), '/')[2:], lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')), lambda x: length(x) >= 3)) AS q FROM tr)),
f AS (SELECT name, min(trained) AS familiar FROM a JOIN b ON p = q OR (length(p) >= 5 AND length(q) >= 5 AND (contains(p, q) OR contains(q, p))) GROUP BY name)
SELECT cand.name, familiar FROM cand LEFT JOIN f USING (name)""")
def familiar_name_theta(spark: SparkSession, d: str) -> DataFrame:
    docs, events = read(spark, d, "documents"), read(spark, d, "events")
    cand = events.select(F.concat(F.lit("x/"), "event_type", F.lit("_task")).alias("name")).union(docs.select(F.concat(F.lit("x/"), "source"))).distinct()
    trained = events.select(F.concat(F.lit("y/"), "event_type").alias("name")).union(docs.where("source < 'src2'").select(F.concat(F.lit("z/"), "lang", F.lit("/"), "source"))).distinct()
    return novelty.familiar(cand, trained)


_PREFIXES = ["flan__", "web7_click_log", "web__view", "posttrain_signup_flow"]


@query(f"""WITH s AS (SELECT DISTINCT 'c/' || event_type AS source FROM events UNION SELECT 'c/sst_two' UNION SELECT 'plain'), tok AS (SELECT source, trim(regexp_replace(lower(CASE WHEN contains(source, '/') THEN regexp_replace(source, '^[^/]*/', '') ELSE source END), '[^a-z0-9]+', '_', 'g'), '_') AS token FROM s),
p AS (SELECT prefix, regexp_replace(trim(regexp_replace(lower(prefix), '[^a-z0-9]+', '_', 'g'), '_'), '^web\\d*_', '') AS core FROM (SELECT unnest({_PREFIXES}) AS prefix)),
r AS (SELECT source, 'name:' || prefix AS reason FROM tok JOIN p ON length(core) >= 4 AND (contains(token, core) OR (length(token) >= 4 AND contains(core, token))) UNION SELECT source, 'family:' || t FROM tok, (SELECT unnest({list(novelty.FAMILY_TASKS)}) AS t) WHERE token = t OR starts_with(token, t || '_') OR ends_with(token, '_' || t))
SELECT source, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY source""")
def name_overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    sources = read(spark, d, "events").select(F.concat(F.lit("c/"), "event_type").alias("source")).distinct().union(spark.createDataFrame([("c/sst_two",), ("plain",)], "source string"))
    out = novelty.audit_names(sources, spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string"), r"web\d*_")
    return out.select("source", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {LABELLED} SELECT part, count(*)::BIGINT AS n FROM (SELECT CASE WHEN out_ AND split = 'validation' THEN 'heldout' WHEN out_ THEN 'removed' ELSE split END AS part FROM (SELECT split, source IN ('en/src1', 'de/src3', 'en/src0') AS out_ FROM labelled WHERE split <> 'test')) GROUP BY part HAVING part <> 'removed'")
def derive_move(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    train, validation, heldout = novelty.derive(rows.where("split = 'train'"), rows.where("split = 'validation'"), rows.where("false"), ["en/src1", "de/src3", "en/src0"])
    parts = [("train", train), ("validation", validation), ("heldout", heldout)]
    out = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("part"))
        out = one if out is None else out.union(one)
    return out.groupBy("part").agg(F.count("*").alias("n"))


#: Every third case's target is uncertain, every seventh's options are three.
_UNSURE = LABELLED + """, unsure AS (SELECT * EXCLUDE (target, options), CASE WHEN case_id::BIGINT % 3 = 0 THEN list_transform(target, lambda t: 0.8 * t + 0.1) ELSE target END::DOUBLE[] AS target, CASE WHEN case_id::BIGINT % 7 = 0 THEN ['a', 'b', 'c'] ELSE options END AS options FROM labelled)"""


def unsure(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("case_id").cast("long")
    rows = labelled(spark, d).withColumn("target", F.when(i % 3 == 0, F.transform("target", lambda t: 0.8 * t + 0.1)).otherwise(F.col("target")))
    return rows.withColumn("options", F.when(i % 7 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.col("options")))


@query(f"WITH {_UNSURE} SELECT count(*)::BIGINT AS n, round(avg((len(options) = 2)::INT::DOUBLE), 6) AS binary_share, round(avg((list_max(target) < 1 - 1e-6)::INT::DOUBLE), 6) AS soft_share, round(avg(-list_sum(list_transform(target, lambda t: CASE WHEN t > 0 THEN t * log2(t) ELSE 0 END))), 6) AS entropy_bits, round(avg(list_max(target)), 6) AS top_mass, max(least(len(options), 27))::BIGINT AS most_options FROM unsure")
def diversity_report(spark: SparkSession, d: str) -> DataFrame:
    out = report.diversity(unsure(spark, d).withColumn("soft", ar.is_soft(F.col("target"))))
    return r6(out, "binary_share", "soft_share", "entropy_bits", "top_mass")


@query(f"""WITH {_UNSURE}, v AS (SELECT unnest([['dataset', dataset], ['language', language], ['kind', kind], ['options', least(len(options), 27)::VARCHAR], ['source', source]]) AS x FROM unsure),
c AS (SELECT * FROM (SELECT x[1] AS field, x[2] AS value, count(*) AS n FROM v GROUP BY 1, 2) QUALIFY field <> 'source' OR row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 10)
SELECT field, value, n::BIGINT AS n, round(n / (SELECT count(*) FROM unsure), 6) AS share FROM c""")
def diversity_shares(spark: SparkSession, d: str) -> DataFrame:
    return r6(report.diversity_shares(unsure(spark, d), ["dataset", "language", "kind"]), "share")


@query("WITH per AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS total FROM per) SELECT round(exp(-sum(n / total * ln(n / total))), 6) AS effective_sources, round(max(n) / any_value(total), 6) AS top1_share, round((SELECT sum(n) FROM (SELECT n FROM per ORDER BY n DESC LIMIT 10)) / any_value(total), 6) AS top10_share, count(*) FILTER (WHERE n >= 1000)::BIGINT AS sources_over_1000, count(*)::BIGINT AS sources FROM per, t")
def effective_sources(spark: SparkSession, d: str) -> DataFrame:
    return r6(report.effective_sources(read(spark, d, "documents")), "effective_sources", "top1_share", "top10_share")


@query("SELECT floor(quantile_cont(length(text), 0.5))::BIGINT AS p50, floor(quantile_cont(length(text), 0.9))::BIGINT AS p90, floor(quantile_cont(length(text), 0.99))::BIGINT AS p99 FROM documents")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return report.length_percentiles(read(spark, d, "documents"), "text")


_SCORES = "scores AS (SELECT p_brand AS benchmark, 'm' || (p_size % 3) AS model, round(avg(p_retailprice), 4) AS score FROM part WHERE NOT (p_brand = 'Brand#11' AND p_size % 3 = 1) GROUP BY 1, 2)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").where("not (p_brand = 'Brand#11' and p_size % 3 = 1)").groupBy(F.col("p_brand").alias("benchmark"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")).alias("model")).agg(F.round(F.avg("p_retailprice"), 4).alias("score"))


@query(f"WITH {_SCORES} SELECT benchmark, max(score) FILTER (WHERE model = 'm0') AS m0, max(score) FILTER (WHERE model = 'm1') AS m1, max(score) FILTER (WHERE model = 'm2') AS m2 FROM scores GROUP BY benchmark")
def model_benchmark_pivot(spark: SparkSession, d: str) -> DataFrame:
    return report.model_pivot(_scores(spark, d), ["m0", "m1", "m2"])


@query(f"WITH {_SCORES}, p AS (SELECT benchmark, max(score) FILTER (WHERE model = 'm0') AS m0, max(score) FILTER (WHERE model = 'm1') AS m1, max(score) FILTER (WHERE model = 'm2') AS m2 FROM scores GROUP BY benchmark) SELECT count(*)::BIGINT AS shared, round(avg(m0), 4) AS m0, round(avg(m1), 4) AS m1, round(avg(m2), 4) AS m2 FROM p WHERE m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL")
def macro_mean_shared(spark: SparkSession, d: str) -> DataFrame:
    out = report.macro_mean(report.model_pivot(_scores(spark, d), ["m0", "m1", "m2"]), ["m0", "m1", "m2"])
    return out.select("shared", *(F.round(m, 4).alias(m) for m in ("m0", "m1", "m2")))


@query(f"WITH {GUARD}, h AS (SELECT t.id, count(*) AS hits FROM grams_tr t JOIN idx USING (fp) GROUP BY t.id), f AS (SELECT tr.src, norm IN (SELECT norm FROM ev) AS exact, coalesce(hits >= 2 OR (hits >= 1 AND n <= 2), false) AS ngram FROM tr LEFT JOIN h USING (id) LEFT JOIN nfp USING (id)) SELECT src AS dataset, count(*)::BIGINT AS requests, count(*) FILTER (WHERE exact)::BIGINT AS exact, count(*) FILTER (WHERE ngram)::BIGINT AS ngram, count(*) FILTER (WHERE exact OR ngram)::BIGINT AS either FROM f GROUP BY src")
def overlap_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Requests that share a state, or fingerprints without a cut for boilerplate, with an index of any source."""
    rows = documents_as_train(spark, d)
    index = guard.build_index(benchmark_as_eval(spark, d), order=F.col("id"), hex_prints=True)
    hits = guard.print_hits(rows, index, "id", source=None, boilerplate=None, hex_prints=True)
    out = rows.select("id", "source").join(hits, "id")
    exact, ngram = F.col("in_states"), F.coalesce(guard.is_leak(F.col("hits"), F.col("n_fps")), F.lit(False))
    return out.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("requests"), F.count_if(exact).alias("exact"), F.count_if(ngram).alias("ngram"), F.count_if(exact | ngram).alias("either"))


@query("SELECT lang, source AS status, count(*)::BIGINT AS n, " + ", ".join(f"count(*) FILTER (WHERE n_chars > {b})::BIGINT AS over_{b}" for b in (512, 1024, 2048, 4096, 8192)) + " FROM documents GROUP BY 1, 2")
def status_lengths(spark: SparkSession, d: str) -> DataFrame:
    return report.status_lengths(read(spark, d, "documents").withColumnRenamed("source", "status"), "lang", "status", "n_chars")


@query(f"WITH {LABELLED} SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(dataset) = 0 THEN 'dataset' ELSE 'all' END AS field, coalesce(split, kind, dataset, '') AS value, count(*)::BIGINT AS n FROM labelled GROUP BY GROUPING SETS ((), (split), (kind), (dataset))")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.counts_by(labelled(spark, d), ["split", "kind", "dataset"])


_PROMPT = "'<|turn>user' || chr(10) || 'State:' || chr(10) || trim(state) || chr(10) || chr(10) || 'Question:' || chr(10) || trim(question) || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || chr(10) || 'Answer with the letter of the correct option.<turn|>' || chr(10) || '<|turn>model' || chr(10)"


@query(f"WITH {LABELLED} SELECT id, sha256({_PROMPT}) AS h, length({_PROMPT})::BIGINT AS n FROM labelled")
def letter_prompt(spark: SparkSession, d: str) -> DataFrame:
    text = render.letter_text(F.col("state"), F.col("question"), F.col("options"))
    return labelled(spark, d).select("id", F.sha2(text, 256).alias("h"), F.length(text).cast("long").alias("n"))


@query("WITH w AS (SELECT doc_id, list_transform(range(1, n_chars + 1), lambda i: i) AS ids FROM documents) SELECT doc_id, len(CASE WHEN len(ids) <= 100 THEN ids ELSE ids[:48] || [0, 0, 0] || ids[len(ids) - 48:] END)::BIGINT AS n, list_sum(CASE WHEN len(ids) <= 100 THEN ids ELSE ids[:48] || [0, 0, 0] || ids[len(ids) - 48:] END)::BIGINT AS s FROM w")
def middle_truncate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.sequence(F.lit(1), F.col("n_chars").cast("int")).alias("ids")).where("size(ids) > 0")
    rows = rows.withColumn("cut", render.truncate_middle(F.col("ids"), F.lit(100), F.array(*[F.lit(0)] * 3)))
    return rows.select("doc_id", F.size("cut").cast("long").alias("n"), F.aggregate("cut", F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))


@query(f"""WITH n AS (SELECT greatest(1, ceil(count(*) / 200.0)) AS chunks FROM documents), c AS (SELECT doc_id, n_chars, floor({u_sql('doc_id', 0)} * chunks)::BIGINT AS chunk FROM documents, n), r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n_chars, doc_id) - 1 AS r FROM c),
b AS (SELECT doc_id, chunk, r // 4 AS batch, r % 4 AS place FROM r), h AS (SELECT chunk, batch, row_number() OVER (ORDER BY {u_sql("(chunk || ':' || batch)", 1)}, chunk, batch) - 1 AS batch_order FROM (SELECT DISTINCT chunk, batch FROM b)) SELECT doc_id, batch_order::BIGINT AS batch_order, place::BIGINT AS place FROM b JOIN h USING (chunk, batch)""")
def length_bucket_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.length_batches(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 4).select("doc_id", "batch_order", "place")


@query("SELECT vec_id, label::BIGINT AS at, round(embedding[label + 1]::DOUBLE, 6) AS x FROM embeddings")
def unpermute(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    perm = render.permutation(F.col("vec_id").cast("string"), F.lit("choice"), F.col("e"))
    e = e.withColumn("perm", perm).withColumn("shown", F.transform("perm", lambda i: F.get("e", i)))
    back = e.withColumn("back", ar.unpermute(F.col("shown"), F.col("perm")))
    return back.select("vec_id", F.col("label").cast("long").alias("at"), F.round(F.get("back", F.col("label").cast("int")).cast("double"), 6).alias("x"))


@query("""WITH per AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), z AS (SELECT p_brand AS id, count(*) AS k, count(*) FILTER (WHERE NOT (p_type LIKE '%BRASS%' OR p_type < 'F')) AS zero FROM per GROUP BY 1)
SELECT id, least(k, 4)::BIGINT AS k, round(CASE WHEN k > 4 AND 4 - (k - zero) > 0 AND zero > 4 - (k - zero) THEN ln(zero / (4 - (k - zero))::DOUBLE) ELSE 0 END, 6) AS "offset" FROM z""")
def negatives_offsets(spark: SparkSession, d: str) -> DataFrame:
    from .q_data import part_sets

    out = render.sample_negatives(part_sets(spark, d), 4)
    return out.select("id", F.size("options").cast("long").alias("k"), F.round("offset", 6).alias("offset"))


@query(f"""WITH {LABELLED}, l AS (SELECT id, length(trim(state)) AS st, length(trim(question)) AS q, 19 AS pre, 11 AS post FROM labelled), b AS (SELECT *, 256 - 8 - (pre + q + post) - 7 AS budget FROM l),
c AS (SELECT *, CASE WHEN st <= budget THEN st ELSE greatest(budget - 5, 2) + 5 END AS cut FROM b), f AS (SELECT *, 8 + cut + pre + q + post AS front FROM c)
SELECT id, 'ok' AS status, front + 7 AS n, front AS yes_start, front + 3 AS yes_end, front + 4 AS no_start, front + 6 AS no_end, 8 + cut + pre AS q_start, 8 + cut + pre + q AS q_end FROM f""")
def rendered_spans(spark: SparkSession, d: str) -> DataFrame:
    """Whole states in prompts of 256 ids at most, cut in the middle, and where the options and the question stand."""
    out = render.render(labelled(spark, d), "clef", max_len=256)
    at = lambda i, side: F.get("spans", F.lit(i))[side].cast("long")
    return out.select("id", "status", F.size("input_ids").cast("long").alias("n"), at(0, "start").alias("yes_start"), at(0, "end").alias("yes_end"), at(1, "start").alias("no_start"), at(1, "end").alias("no_end"), F.col("qspan.start").cast("long").alias("q_start"), F.col("qspan.end").cast("long").alias("q_end"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type NOT IN ('error') GROUP BY event_type")
def stream_guard(spark: SparkSession, d: str) -> DataFrame:
    """The stream-static anti join over events as a stream, run to its end."""
    from ..streaming import guard as stream

    return stream.counted_once(spark, d)
