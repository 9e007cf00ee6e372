"""Queries on builds, audits, summaries and sets of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extra_eval, guard, metrics, mixture, novelty, report, sampling
from .q_data import PRINTS, _LIC, documents_as_train, licence_rows
from .q_eval import _SETS, _labels_rows, measured, r6
from .q_mix import fill_sql
from .relations import LABELLED, MEASURED, labelled, read, u_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"

#: Documents as candidates against benchmark items as training: fingerprints are boilerplate by the candidates' side.
_CAND = (
    f"tr0 AS (SELECT item_id AS id, 'b' AS src, {_NORM.format('text')} AS norm FROM benchmark), tr1 AS (SELECT * FROM tr0 QUALIFY row_number() OVER (PARTITION BY norm ORDER BY id) = 1), ca AS (SELECT doc_id AS id, source AS src, {_NORM.format('text')} AS norm FROM documents),"
    + PRINTS.format("tr1") + "," + PRINTS.format("ca") + """,
fresh AS (SELECT * FROM ca WHERE norm NOT IN (SELECT norm FROM tr1)), own AS (SELECT g.id, g.fp, f.norm FROM grams_ca g JOIN fresh f USING (id)),
rare AS (SELECT fp FROM own GROUP BY fp HAVING count(DISTINCT norm) <= 3), shared AS (SELECT fp FROM rare WHERE fp IN (SELECT fp FROM grams_tr1)),
nfp AS (SELECT id, count(*) AS n FROM own GROUP BY id), hits AS (SELECT id, count(*) AS hits FROM own JOIN shared USING (fp) GROUP BY id),
leaks AS (SELECT ca.id, src, CASE WHEN norm IN (SELECT norm FROM tr1) THEN 'leak_state_in_train' WHEN hits >= 2 OR (hits >= 1 AND n <= 2) THEN 'leak_ngram_in_train' END AS leak FROM ca LEFT JOIN hits USING (id) LEFT JOIN nfp USING (id))"""
)


@query(f"WITH {_CAND} SELECT id, src AS source, coalesce(leak, 'kept') AS leak FROM leaks")
def leak_filter(spark: SparkSession, d: str) -> DataFrame:
    states = read(spark, d, "benchmark").select(F.col("text").alias("state"))
    out = guard.leak_filter(documents_as_train(spark, d), states, hex_prints=True)
    return out.select("id", "source", F.coalesce("leak", F.lit("kept")).alias("leak"))


#: Every 97th document also stands on the evaluation side, with other white space.
_PLANTED = f"ev AS (SELECT {_NORM.format('text')} AS norm FROM benchmark UNION SELECT {_NORM.format('text')} FROM documents WHERE doc_id % 97 = 0)"


@query(f"WITH {_PLANTED} SELECT doc_id AS id, source FROM documents WHERE {_NORM.format('text')} IN (SELECT norm FROM ev)")
def leak_exact_planted(spark: SparkSession, d: str) -> DataFrame:
    docs = documents_as_train(spark, d)
    planted = docs.where("id % 97 = 0").select("id", F.lit("planted").alias("source"), F.lit(None).cast("string").alias("group_id"), F.concat(F.lit(" \n"), F.replace("state", F.lit(" "), F.lit("\t\n ")), F.lit("\t ")).alias("state"))
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source"), F.lit(None).cast("string").alias("group_id"), F.col("text").alias("state"))
    index = guard.build_index(items.union(planted), order=F.col("id"), hex_prints=True)
    return guard.flag_leaks(docs, index, hex_prints=True).where("leak = 'leak_state'").select("id", "source")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id, text FROM documents EXCEPT ALL SELECT doc_id, CASE WHEN doc_id = (SELECT max(doc_id) FROM documents) THEN text || ' ' ELSE text END FROM documents)) = 0 AS equal, count(*)::BIGINT AS n FROM documents")
def frozen_digest_changed(spark: SparkSession, d: str) -> DataFrame:
    """A copy with one changed text, which the digest must tell."""
    a = read(spark, d, "documents").select("doc_id", "text")
    last = a.agg(F.max("doc_id")).first()[0]
    changed = a.withColumn("text", F.when(F.col("doc_id") == last, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    one, two = guard.digest(a, ["doc_id", "text"]), guard.digest(changed, ["doc_id", "text"])
    return one.alias("x").join(two.alias("y"), how="cross").select(F.expr("x.n = y.n and x.a = y.a and x.b = y.b").alias("equal"), F.col("x.n").alias("n"))


#: The mixture's cascade over labelled rows, training against the rest.
_CASCADE = (
    f"{LABELLED}, seqd AS (SELECT *, row_number() OVER (ORDER BY id) AS seq, {_NORM.format('state')} AS norm FROM labelled), ev AS (SELECT * FROM seqd WHERE split <> 'train'), tr AS (SELECT *, seq AS nr FROM seqd WHERE split = 'train'),"
    "pre AS (SELECT *, source AS src, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY seq) > 30 THEN 'read_limit' WHEN length(state) > 3000 THEN 'state_too_long' WHEN source IN ('en/src2', 'de/src4') THEN 'excluded_source' WHEN source LIKE 'fr/src1%' THEN 'held_out_task' END AS r0 FROM tr),"
    "ev0 AS (SELECT *, CASE WHEN length(state) > 3000 THEN 'state_too_long' END AS r0, source AS src FROM ev), ev1 AS (SELECT * FROM ev0 WHERE r0 IS NULL QUALIFY row_number() OVER (PARTITION BY norm ORDER BY seq) = 1), alive AS (SELECT * FROM pre WHERE r0 IS NULL),"
    + PRINTS.format("ev1") + "," + PRINTS.format("alive") + """,
idx AS (SELECT fp, count(*) AS df, min(src) AS s0, max(src) AS s1 FROM grams_ev1 GROUP BY fp),
hits AS (SELECT t.id, count(*) AS hits FROM grams_alive t JOIN idx USING (fp) WHERE df <= 3 AND (s0 <> t.src OR s1 <> t.src) GROUP BY t.id), nfp AS (SELECT id, count(*) AS n FROM grams_alive GROUP BY id),
led AS (SELECT a.*, CASE WHEN norm IN (SELECT norm FROM ev1) THEN 'leak_state' WHEN group_id IN (SELECT group_id FROM ev0 WHERE r0 IS NULL) THEN 'leak_group' WHEN hits >= 2 OR (hits >= 1 AND n <= 2) THEN 'leak_ngram' END AS r1 FROM alive a LEFT JOIN hits USING (id) LEFT JOIN nfp USING (id)),
dup AS (SELECT *, coalesce(r1, CASE WHEN row_number() OVER (PARTITION BY """ + _NORM.format("state || ' ' || question || ' yes no'") + """, r1 IS NULL ORDER BY seq) > 1 THEN 'duplicate' END) AS r2 FROM led)"""
)


#: Rows in training: under what the sources hold, so that quotas bind.
_TOTAL = 100
_TRAIN = f"""pool AS (SELECT *, ln((('0x' || substr(sha256('8:' || id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS p FROM dup WHERE r2 IS NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY {u_sql('id', 7)}, id) <= 5),
held AS (SELECT source, count(*) AS n FROM pool GROUP BY source), {fill_sql('quota', 'SELECT source, n::DOUBLE AS b, sqrt(n::DOUBLE) AS w FROM held', str(_TOTAL))},
chosen AS (SELECT id, source FROM pool JOIN quota USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY p DESC, id) <= q)"""


def _mixture(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    rows = labelled(spark, d).withColumn("variant", F.lit(None).cast("string")).withColumn("seq", F.col("id"))  # the order of ids is the order of arrival
    s = mixture.Settings(max_chars=3000, read_limit=30, per_source_cap=5, total=_TOTAL, excluded=["en/src2", "de/src4"], held_out=["fr/src1*"], hex_prints=True, eval_caps={"validation": 3, "test": 4, "heldout": 6})
    return mixture.build(rows.where("split = 'train'"), rows.where("split <> 'train'"), s)


@query(f"WITH {_CASCADE} SELECT dataset, 'train' AS \"pass\", coalesce(r0, r2) AS reason, count(*)::BIGINT AS n FROM (SELECT dataset, r0, NULL AS r2 FROM pre WHERE r0 IS NOT NULL UNION ALL SELECT dataset, NULL, r2 FROM dup WHERE r2 IS NOT NULL) GROUP BY 1, 3 UNION ALL SELECT dataset, 'eval', r0, count(*)::BIGINT FROM ev0 WHERE r0 IS NOT NULL GROUP BY 1, 3")
def mixture_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)["ledger"]


@query(f"WITH RECURSIVE {_CASCADE}, {_TRAIN} SELECT id, source FROM chosen")
def mixture_train_rows(spark: SparkSession, d: str) -> DataFrame:
    """The training rows themselves, under quotas that bind."""
    return _mixture(spark, d)["train"].select("id", "source")


@query(f"""WITH RECURSIVE {_CASCADE}, {_TRAIN}, t AS (SELECT 'train' AS part, source, count(*) AS n FROM chosen GROUP BY source),
e AS (SELECT *, CASE WHEN source LIKE 'fr/src1%' THEN 'heldout' WHEN split = 'test' THEN 'test' WHEN {u_sql('group_id', 9)} < 0.5 THEN 'calib' ELSE 'validation' END AS part FROM ev0 WHERE r0 IS NULL),
c AS (SELECT part, source, least(count(*), CASE part WHEN 'heldout' THEN 6 WHEN 'test' THEN 4 ELSE 3 END) AS n FROM e GROUP BY 1, 2)
SELECT part, count(*)::BIGINT AS sources, sum(n)::BIGINT AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM c) GROUP BY part""")
def mixture_parts(spark: SparkSession, d: str) -> DataFrame:
    built = _mixture(spark, d)
    out = None
    for part in ("train", "validation", "calib", "heldout", "test"):
        one = built[part].select(F.lit(part).alias("part"), "source")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("part").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n"))


def _candidates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose source ends in an even character as candidates, the benchmark and the other documents as training."""
    docs = documents_as_train(spark, d)
    even = F.ascii(F.right("source", F.lit(1))) % 2 == 0
    long = F.length("state") > 1500
    options = F.when(F.col("source") == "src4", F.array(F.lit("seen"), F.lit("both"))).when(F.col("source") == "src6", F.array(F.concat(F.lit("item "), F.col("id").cast("string")), F.lit("x"))).otherwise(F.array(F.concat("source", F.when(long, " long").otherwise(" short")), F.lit("other")))
    rows = docs.select(F.col("id").cast("string").alias("id"), F.lit("set").alias("dataset"), "source", F.lit("validation").alias("split"), F.when(F.col("source") == "src8", "cc-by-nc-4.0").otherwise("mit").alias("license"), F.lit("choice").alias("kind"), "state", F.lit("which?").alias("question"), options.alias("options"), F.array(F.lit(1.0), F.lit(0.0)).alias("target"), F.lit(None).cast("array<double>").alias("option_values"))
    trained = rows.where(~even).select("source", "state", F.array(F.lit("Seen"), F.lit(" both ")).alias("options")).union(read(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("text").alias("state"), F.array(F.lit("a"), F.lit("b")).alias("options")))
    return rows.where(even), trained


_EXTRA = (
    f"docs AS (SELECT doc_id AS id, source AS src, text, {_NORM.format('text')} AS norm, ascii(right(source, 1)) % 2 = 0 AS even FROM documents), tr0 AS (SELECT norm FROM docs WHERE NOT even UNION SELECT {_NORM.format('text')} FROM benchmark), tr1 AS (SELECT row_number() OVER (ORDER BY norm) AS id, 'b' AS src, norm FROM tr0),"
    "ca AS (SELECT * FROM docs WHERE even AND src <> 'src8' AND length(text) <= 2600),"
    + PRINTS.format("tr1") + "," + PRINTS.format("ca") + """,
fresh AS (SELECT * FROM ca WHERE norm NOT IN (SELECT norm FROM tr1)), own AS (SELECT g.id, g.fp, f.norm FROM grams_ca g JOIN fresh f USING (id)),
rare AS (SELECT fp FROM own GROUP BY fp HAVING count(DISTINCT norm) <= 3), shared AS (SELECT fp FROM rare WHERE fp IN (SELECT fp FROM grams_tr1)),
nfp AS (SELECT id, count(*) AS n FROM own GROUP BY id), hits AS (SELECT id, count(*) AS hits FROM own JOIN shared USING (fp) GROUP BY id),
leaks AS (SELECT ca.*, CASE WHEN ca.norm IN (SELECT norm FROM tr1) THEN 'leak_state_in_train' WHEN hits >= 2 OR (hits >= 1 AND n <= 2) THEN 'leak_ngram_in_train' END AS leak FROM ca LEFT JOIN hits USING (id) LEFT JOIN nfp USING (id)),
kept AS (SELECT *, CASE WHEN src = 'src4' THEN 'both|seen' WHEN src = 'src6' THEN 'item ' || id || '|x' WHEN length(text) > 1500 THEN 'other|' || src || ' long' ELSE 'other|' || src || ' short' END AS st FROM leaks WHERE leak IS NULL),
sets AS (SELECT src, st, count(*) AS n FROM kept GROUP BY 1, 2),
per AS (SELECT src, sum(n) AS n_rows, sum(CASE WHEN n >= 5 THEN n ELSE 0 END)::DOUBLE / sum(n) AS rep, sum(CASE WHEN st IN ('both|seen', 'a|b') THEN n ELSE 0 END)::DOUBLE / sum(n) AS seen FROM sets GROUP BY src),
strs AS (SELECT DISTINCT src, unnest(string_split(st, '|')) AS s FROM sets), ov AS (SELECT src, avg((s IN ('seen', 'both', 'a', 'b'))::INT::DOUBLE) AS overlap FROM strs GROUP BY src),
sources AS (SELECT src AS source, n_rows, rep, seen, overlap, CASE WHEN n_rows < 8 THEN 'n_rows' WHEN rep < 0.5 THEN 'repeat_fraction' WHEN seen > 0.1 THEN 'seen_fraction' WHEN overlap > 0.3 THEN 'string_overlap' END AS rejected FROM per JOIN ov USING (src))"""
)


def _extra(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    s = extra_eval.Settings(min_eval=8, per_source=None, max_chars=2600, min_repeat=5, hex_prints=True)
    return extra_eval.build(*_candidates(spark, d), s)


@query(f"WITH {_EXTRA} SELECT source, n_rows::BIGINT AS n_rows, round(rep, 6) AS repeat_fraction, round(seen, 6) AS seen_fraction, round(overlap, 6) AS string_overlap, coalesce(rejected, 'chosen') AS verdict FROM sources")
def extra_eval_sources(spark: SparkSession, d: str) -> DataFrame:
    per = _extra(spark, d)["sources"].withColumn("verdict", F.coalesce("rejected", F.lit("chosen")))
    return r6(per.drop("rejected", "familiar"), "repeat_fraction", "seen_fraction", "string_overlap")


@query(f"WITH {_EXTRA} SELECT id::VARCHAR AS id, src AS source FROM kept JOIN sources ON src = source WHERE rejected IS NULL")
def extra_eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return _extra(spark, d)["rows"].select("id", "source")


@query(f"WITH {_EXTRA} SELECT reason, count(*)::BIGINT AS n FROM (SELECT leak AS reason FROM leaks WHERE leak IS NOT NULL UNION ALL SELECT CASE WHEN src = 'src8' THEN 'licence:non_commercial' ELSE 'invalid_or_too_long' END FROM docs WHERE even AND (src = 'src8' OR length(text) > 2600)) GROUP BY reason")
def extra_eval_drops(spark: SparkSession, d: str) -> DataFrame:
    return _extra(spark, d)["drops"]


_POLICY = ["flan__", "web7_click_log", "web__view", "posttrain_signup_flow", "hub__", "lists__a"]
_AUDITED = f"""s AS (SELECT DISTINCT 'c/' || event_type AS source, 'c' AS dataset FROM events UNION SELECT 'hub/' || lower(r_name) || '/en', 'hub' FROM region UNION SELECT 'hub/sst_two', 'hub' UNION SELECT lower(r_name) || '/x' || r_regionkey, 'names' FROM region UNION SELECT 'lists/' || n_nationkey, 'lists' FROM nation),
tok AS (SELECT *, trim(regexp_replace(lower(regexp_replace(source, '^[^/]*/', '')), '[^a-z0-9]+', '_', 'g'), '_') AS token FROM s),
p AS (SELECT prefix, regexp_replace(trim(regexp_replace(lower(prefix), '[^a-z0-9]+', '_', 'g'), '_'), '^web\\d*_', '') AS core FROM (SELECT unnest({_POLICY}) AS prefix)),
r AS (SELECT source, 'name:' || prefix AS reason FROM tok JOIN p ON length(core) >= 4 AND (contains(token, core) OR (length(token) >= 4 AND contains(core, token))) UNION SELECT source, 'collection:lists__a' FROM s WHERE dataset = 'lists'
 UNION SELECT source, unnest(['family:flan__', 'family:hub__']) FROM tok WHERE EXISTS (SELECT 1 FROM (SELECT unnest({list(novelty.FAMILY_TASKS)}) AS t) WHERE token = t OR starts_with(token, t || '_') OR ends_with(token, '_' || t))),
parts AS (SELECT DISTINCT trim(regexp_replace(lower(part), '[^a-z0-9]+', '_', 'g'), '_') AS part FROM (SELECT unnest(string_split(source, '/')[2:]) AS part FROM s WHERE dataset = 'hub')),
names AS (SELECT source, trim(regexp_replace(lower(string_split(source, '/')[1]), '[^a-z0-9]+', '_', 'g'), '_') AS part FROM s WHERE dataset <> 'hub' UNION ALL SELECT source, dataset FROM s WHERE dataset <> 'hub'),
al AS (SELECT source, 'alias:hub contains ''' || min(part) || '''' AS reason FROM names JOIN parts USING (part) WHERE source NOT IN (SELECT source FROM r) GROUP BY source),
matches AS (SELECT source, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT * FROM r UNION ALL SELECT * FROM al) GROUP BY source)"""


def _audited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    region, nation, events = (read(spark, d, t) for t in ("region", "nation", "events"))
    name = F.lower("r_name")
    s = events.select(F.concat(F.lit("c/"), "event_type").alias("source"), F.lit("c").alias("dataset")).distinct()
    s = s.union(region.select(F.concat(F.lit("hub/"), name, F.lit("/en")), F.lit("hub"))).union(spark.createDataFrame([("hub/sst_two", "hub")], "source string, dataset string"))
    s = s.union(region.select(F.concat(name, F.lit("/x"), F.col("r_regionkey").cast("string")), F.lit("names"))).union(nation.select(F.concat(F.lit("lists/"), F.col("n_nationkey").cast("string")), F.lit("lists")))
    return s, novelty.policy_overlap(s, _POLICY, {"lists": ["lists__a", "lists__b"], "other": ["web__view"]}, ["flan__", "absent__", "hub__", "web__view"], "hub", "hub__", r"web\d*_")


@query(f"WITH {_AUDITED} SELECT source, reasons FROM matches")
def policy_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d)[1].select("source", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_AUDITED} SELECT dataset, count(*)::BIGINT AS sources, count(*) FILTER (WHERE source IN (SELECT source FROM matches))::BIGINT AS flagged FROM s GROUP BY dataset")
def flagged_by_collection(spark: SparkSession, d: str) -> DataFrame:
    return novelty.flagged_by_collection(*_audited(spark, d))


@query(f"""WITH {_SETS}, kinds AS (SELECT source, arg_min(kind, (-n, kind)) AS kind FROM (SELECT source, CASE WHEN id % 3 = 0 THEN 'noul' ELSE 'choice' END AS kind, count(*) AS n FROM rows GROUP BY 1, 2) GROUP BY source),
med AS (SELECT source, k FROM (SELECT source, len(list_distinct(options)) AS k, row_number() OVER (PARTITION BY source ORDER BY len(list_distinct(options)), id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM rows) WHERE r = n // 2),
top AS (SELECT source, arg_min("set", (-n, "set")) AS st FROM stats GROUP BY source)
SELECT source, kind, k::BIGINT AS median_options, array_to_string(string_split(st, chr(31))[:8], '|') AS label_set FROM kinds JOIN med USING (source) JOIN top USING (source)""")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _labels_rows(spark, d).withColumn("kind", F.when(F.col("id") % 3 == 0, "noul").otherwise("choice"))
    return novelty.label_summary(rows).withColumn("label_set", F.array_join("label_set", "|"))


_AREAS = "areas AS (SELECT p_brand AS run, 's' || (p_size % 3) AS area, avg(p_retailprice) AS skill, CASE WHEN p_size % 3 = 2 THEN NULL ELSE count(*) FILTER (WHERE p_size < 30)::DOUBLE / count(*) END AS coverage FROM part WHERE NOT (p_brand = 'Brand#12' AND p_size % 3 = 1) GROUP BY 1, 2, p_size % 3), runs AS (SELECT p_brand AS run, avg(p_size) AS index, max(p_size)::DOUBLE AS raw_index FROM part GROUP BY 1)"


@query(f"WITH {_AREAS} SELECT run, round(any_value(index), 6) AS index, any_value(raw_index) AS raw_index, round(max(skill) FILTER (WHERE area = 's0'), 6) AS s0, round(max(skill) FILTER (WHERE area = 's1'), 6) AS s1, round(max(skill) FILTER (WHERE area = 's2'), 6) AS s2, round(100 * avg(coverage), 6) AS coverage FROM runs LEFT JOIN areas USING (run) GROUP BY run")
def area_summary(spark: SparkSession, d: str) -> DataFrame:
    part, at = read(spark, d, "part"), F.col("p_size") % 3
    areas = part.where("not (p_brand = 'Brand#12' and p_size % 3 = 1)").groupBy(F.col("p_brand").alias("run"), F.concat(F.lit("s"), at.cast("string")).alias("area")).agg(F.avg("p_retailprice").alias("skill"), F.avg((F.col("p_size") < 30).cast("double")).alias("coverage"))
    areas = areas.withColumn("coverage", F.when(F.col("area") != "s2", F.col("coverage")))
    runs = part.groupBy(F.col("p_brand").alias("run")).agg(F.avg("p_size").alias("index"), F.max("p_size").cast("double").alias("raw_index"))
    out = report.area_summary(areas, runs, ["s0", "s1", "s2"])
    return out.withColumns({"index": F.round("index", 6), "coverage": F.round("coverage", 6), **{c: F.round(c, 6) for c in ("s0", "s1", "s2")}})


@query("""WITH pages AS (SELECT r_name AS folder, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Template' WHEN 2 THEN 'Concept' ELSE 'Note' END AS type, n_name AS title, lower(n_name) || '.md' AS path, CASE WHEN n_nationkey % 3 = 0 THEN 'draft' END AS status, CASE WHEN n_nationkey % 5 <> 0 THEN 'about ' || n_name END AS description FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT folder, coalesce(type, 'Other') AS type, string_agg('* [' || title || '](/' || path || ') - ' || coalesce('[' || status || '] ', '') || coalesce(description, ''), chr(10) ORDER BY path) AS entries FROM pages GROUP BY 1, 2)
SELECT folder, type, entries, row_number() OVER (PARTITION BY folder ORDER BY type = 'Template', type)::BIGINT AS place FROM g""")
def folder_index(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    pages = rows.select(F.col("r_name").alias("folder"), F.when(k % 4 == 1, "Template").when(k % 4 == 2, "Concept").when(k % 4 == 3, "Note").alias("type"), F.col("n_name").alias("title"), F.concat(F.lower("n_name"), F.lit(".md")).alias("path"), F.when(k % 3 == 0, "draft").alias("status"), F.when(k % 5 != 0, F.concat(F.lit("about "), "n_name")).alias("description"))
    return report.folder_index(pages).withColumn("entries", F.array_join("entries", "\n"))


@query(f"WITH {_LIC} SELECT l AS license, count(*)::BIGINT AS n FROM lic JOIN known USING (l) WHERE doc_id % 2 = 0 AND reason IN ('ok', 'share_alike') AND canon NOT IN ('cc0-1.0', 'bsd-2-clause', 'bsd-3-clause') GROUP BY l")
def newly_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Every second licence with a remark, so that those of the list pass only without it; CC0 and BSD names take in whatever follows them, and pass with it."""
    rows = licence_rows(spark, d).withColumn("license", F.when(F.col("doc_id") % 2 == 0, F.concat("l", F.lit(" (original source)"))).otherwise(F.col("l")))
    return report.newly_admitted(rows, ["l"]).withColumnRenamed("l", "license")


@query(f"SELECT doc_id FROM (SELECT doc_id, {u_sql('doc_id', 4)} AS u FROM documents WHERE lang = 'en') ORDER BY u, doc_id LIMIT 40")
def smoke_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "test").otherwise("validation").alias("split"))
    return metrics.evaluation_rows(rows, "test", final=True, limit=40, identity="doc_id", seed=4).select("doc_id")


@query(f"WITH {LABELLED} SELECT DISTINCT source FROM labelled WHERE split = 'train' EXCEPT SELECT source FROM labelled WHERE split <> 'train' AND length(state) > 2000")
def sources_without_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d)
    return sampling.missing(rows.where("split = 'train'"), rows.where("split <> 'train' and length(state) > 2000"), "source")


@query("SELECT lang, source, n::BIGINT AS n, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS place FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)) WHERE place <= 6")
def most_common_sources(spark: SparkSession, d: str) -> DataFrame:
    return sampling.most_common(read(spark, d, "documents"), ["lang"], "source", 6)


@query(f"WITH {MEASURED}, res AS (SELECT label, count(*) AS n, avg(correct) AS acc, avg(nll) AS nll, avg(brier) AS brier, avg(conf) AS c FROM measured GROUP BY label) SELECT CASE WHEN label IN (1, 4, 7) THEN 'seen' ELSE 'not_flagged' END AS part, sum(n)::BIGINT AS n, round(sum(n * acc) / sum(n), 6) AS acc, round(sum(n * nll) / sum(n), 6) AS nll, round(sum(n * brier) / sum(n), 6) AS brier, round(sum(n * c) / sum(n), 6) AS mean_conf FROM res GROUP BY 1")
def seen_split(spark: SparkSession, d: str) -> DataFrame:
    res = measured(spark, d).groupBy(F.col("label").cast("long").alias("source")).agg(F.count("*").alias("n"), F.avg("correct").alias("acc"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"), F.avg("conf").alias("mean_conf"))
    out = metrics.split_by_seen(res, spark.createDataFrame([(1,), (4,), (7,)], "source long"))
    return r6(out, "acc", "nll", "brier", "mean_conf")
