"""The driver's tables as decisions, so that every operator has real rows; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import text as tx


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """documents with labels as noul decisions, one for each label."""
    both = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    rows = both.select("doc_id", "lang", F.col("source").alias("src"), F.col("text").alias("state"), F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (attr, v)"))
    key = F.col("doc_id").cast("string")
    return rows.select(
        F.concat_ws(":", key, "attr").alias("id"), key.alias("case_id"), F.concat(F.lit("g:"), key).alias("group_id"), F.col("src").alias("dataset"), F.concat_ws("/", "lang", "src").alias("source"),
        F.when(tx.uniform(key, 5) < 0.6, "train").when(tx.uniform(key, 5) < 0.8, "validation").otherwise("test").alias("split"), F.col("lang").alias("language"), F.lit("mit").alias("license"), F.lit("noul").alias("kind"),
        "state", F.concat(F.lit("Is it "), "attr", F.lit("?")).alias("question"), F.array(F.lit("yes"), F.lit("no")).alias("options"), F.array(F.col("v").cast("double"), 1 - F.col("v").cast("double")).alias("target"), F.lit(None).cast("array<double>").alias("option_values"),
    )


U = "(('0x' || substr(sha256('{seed}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def u_sql(key: str, seed: int) -> str:
    return U.format(seed=seed, key=key)


LABELLED = f"""labelled AS (SELECT concat_ws(':', d.doc_id, attr) AS id, d.doc_id::VARCHAR AS case_id, 'g:' || d.doc_id AS group_id, d.source AS dataset, d.lang || '/' || d.source AS source,
 CASE WHEN {u_sql('d.doc_id', 5)} < 0.6 THEN 'train' WHEN {u_sql('d.doc_id', 5)} < 0.8 THEN 'validation' ELSE 'test' END AS split, d.lang AS language, 'noul' AS kind,
 d.text AS state, 'Is it ' || attr || '?' AS question, ['yes', 'no'] AS options, [v::DOUBLE, 1 - v::DOUBLE] AS target
 FROM documents d JOIN (SELECT doc_id, 'quality' AS attr, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l USING (doc_id))"""


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as choices among their labels, with logits from the labels' mean vectors."""
    e = read(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    all_ = vectors.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "c"))), lambda s: s["c"]).alias("cs"))  # as many as labels
    dot = lambda c: F.aggregate(F.zip_with("embedding", c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) * 100
    return e.join(F.broadcast(all_), how="cross").select(F.col("vec_id").alias("id"), "label", F.lit("choice").alias("kind"), F.transform("cs", dot).alias("logits"), ar.one_hot(F.col("label"), 10).alias("target"))


EMBEDDED = """cent AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY label, i),
cvec AS (SELECT label, list(x ORDER BY i) AS c FROM cent GROUP BY label), call_ AS (SELECT list(c ORDER BY label) AS cs FROM cvec),
embedded AS (SELECT vec_id AS id, label, 'choice' AS kind, list_transform(cs, lambda c: 100 * list_inner_product(embedding::DOUBLE[], c)) AS logits,
 list_transform(range(0, 10), lambda k: CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS target FROM embeddings, call_)"""


def predicted(spark: SparkSession, d: str, t: float = 2.0) -> DataFrame:
    return embedded(spark, d).withColumn("p", ar.softmax(F.col("logits"), t))


PREDICTED = EMBEDDED + """,
exped AS (SELECT *, list_transform(logits, lambda x: exp((x - list_max(logits)) / 2.0::DOUBLE)) AS ex FROM embedded),
predicted AS (SELECT id, label, kind, target, logits, list_transform(ex, lambda x: x / list_sum(ex)) AS p FROM exped)"""

#: Metrics of each row of predicted.
MEASURED = PREDICTED + """,
measured AS (SELECT *, list_max(p) AS conf, (target[list_position(p, list_max(p))] >= list_max(target) - 1e-9)::INT::DOUBLE AS correct,
 (list_position(p, list_max(p)) = list_position(target, list_max(target)))::INT::DOUBLE AS acc,
 -list_sum(list_transform(range(1, len(p) + 1), lambda i: target[i] * ln(least(greatest(p[i], 1e-12), 1.0)))) AS nll,
 list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - target[i]) * (p[i] - target[i]))) AS brier,
 list_sum(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN target[i] > 0 THEN target[i] * (ln(target[i]) - ln(least(greatest(p[i], 1e-12), 1.0))) ELSE 0 END)) AS kl FROM predicted)"""


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """orders as scores of five levels; the prediction is the mean of its status and year."""
    from ..operators import metrics

    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("workflow"), F.year("o_orderdate").cast("long").alias("year"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("level"))
    o = o.withColumn("target", ar.one_hot(F.col("level"), 5)).withColumn("option_values", F.array(*(F.lit(float(i)) for i in range(5))))
    return o.join(metrics.prior(o, ["workflow", "year"]).withColumnRenamed("prior", "p"), ["workflow", "year"])


ORDERED = """base AS (SELECT o_orderkey AS id, o_orderstatus AS workflow, year(o_orderdate)::BIGINT AS year, substr(o_orderpriority, 1, 1)::INT - 1 AS level FROM orders),
hot AS (SELECT *, list_transform(range(0, 5), lambda k: CASE WHEN k = level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS target, [0.0, 1.0, 2.0, 3.0, 4.0]::DOUBLE[] AS option_values FROM base),
means AS (SELECT workflow, year, i, avg(target[i]) AS x FROM hot, unnest(range(1, 6)) AS u(i) GROUP BY workflow, year, i),
prior AS (SELECT workflow, year, list(x ORDER BY i) AS p FROM means GROUP BY workflow, year),
ordered AS (SELECT * FROM hot JOIN prior USING (workflow, year))"""
