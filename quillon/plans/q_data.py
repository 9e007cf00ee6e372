"""Queries on text, guards, sampling, validation, licences and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as ar
from ..functions import licenses
from ..functions import text as tx
from ..operators import guard, ingest, render, report, sampling
from ..schema import invalid
from .relations import LABELLED, labelled, read, u_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
DOCN = f"docn AS (SELECT *, {NORM.format('text')} AS norm FROM documents)"
#: md5 fingerprints of an eval and a train table (id, src, norm).
PRINTS = """
grams_{0} AS (SELECT id, src, unnest(list_distinct(list_filter(list_transform(range(1, len(w) - 10), lambda i: md5(array_to_string(w[i:i + 11], ' '))), lambda h: substr(h, 1, 1) IN ('0', '4', '8', 'c')))) AS fp
  FROM (SELECT id, src, string_split(norm, ' ') AS w FROM {0}) WHERE len(w) >= 24)"""


def documents_as_train(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source"), F.concat(F.lit("g:"), F.col("doc_id").cast("string")).alias("group_id"), F.col("text").alias("state"), "lang")


def benchmark_as_eval(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("source"), F.concat(F.lit("g:"), (F.col("item_id") * 7).cast("string")).alias("group_id"), F.col("text").alias("state"))


def index_of(spark: SparkSession, d: str) -> guard.GuardIndex:
    return guard.build_index(benchmark_as_eval(spark, d), order=F.col("id"), hex_prints=True)


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return guard.flag_leaks(documents_as_train(spark, d), index_of(spark, d), hex_prints=True)


GUARD = (
    f"ev AS (SELECT item_id AS id, 'benchmark' AS src, {NORM.format('text')} AS norm, 'g:' || (item_id * 7) AS g FROM benchmark), tr AS (SELECT doc_id AS id, source AS src, {NORM.format('text')} AS norm, 'g:' || doc_id AS g, lang FROM documents), ev1 AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY norm ORDER BY id) = 1),"
    + PRINTS.format("ev1") + "," + PRINTS.format("tr") + """,
idx AS (SELECT fp, count(*) AS df, min(src) AS s0, max(src) AS s1 FROM grams_ev1 GROUP BY fp),
hits AS (SELECT t.id, count(*) AS hits FROM grams_tr t JOIN idx USING (fp) WHERE df <= 3 AND (s0 <> t.src OR s1 <> t.src) GROUP BY t.id),
nfp AS (SELECT id, count(*) AS n FROM grams_tr GROUP BY id),
flagged AS (SELECT tr.*, CASE WHEN norm IN (SELECT norm FROM ev) THEN 'leak_state' WHEN g IN (SELECT g FROM ev) THEN 'leak_group' WHEN hits >= 2 OR (hits >= 1 AND n <= 2) THEN 'leak_ngram' END AS leak FROM tr LEFT JOIN hits USING (id) LEFT JOIN nfp USING (id))"""
)


@query(f"WITH {DOCN} SELECT sha256(norm) AS h, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM docn GROUP BY norm HAVING count(*) > 1")
def norm_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    h = tx.text_hash(F.col("text"))
    return read(spark, d, "documents").groupBy(h.alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query(f"WITH {DOCN} SELECT doc_id, lang FROM docn QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1")
def exact_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return guard.keep_first(read(spark, d, "documents").select("doc_id", "lang", tx.text_hash(F.col("text")).alias("h")), F.col("h"), F.col("doc_id")).select("doc_id", "lang")


@query(f"WITH tr AS (SELECT doc_id AS id, source AS src, {NORM.format('text')} AS norm FROM documents), {PRINTS.format('tr')} SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_fps FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM grams_tr GROUP BY id) ON id = doc_id")
def fingerprints_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return guard.fingerprinted(read(spark, d, "documents"), "text", True, doc_id=F.col("doc_id")).select("doc_id", F.size("fps_").cast("long").alias("n_fps"))


def crc_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return guard.fingerprinted(read(spark, d, "documents"), "text", doc_id=F.col("doc_id")).select("doc_id", F.size("fps_").cast("long").alias("n_fps"))


QUERIES["crc_fingerprints"] = crc_fingerprints


@query(f"SELECT CASE WHEN {u_sql('doc_id', 9)} < 0.5 THEN 'calib' ELSE 'validation' END AS part, count(*)::BIGINT AS n, min(doc_id) AS least FROM documents GROUP BY 1")
def hash_bucket_split(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(sampling.split_by(F.col("doc_id").cast("string"), 0.5, 9), "calib").otherwise("validation")
    return read(spark, d, "documents").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


#: All letters of the given texts are Latin, which the SQL takes for granted; Unicode names aren't known to it.
@query("SELECT CASE WHEN regexp_matches(substr(text, 1, 400), '\\p{L}') THEN 'LATIN' ELSE 'NONE' END AS script, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def script_share(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(tx.dominant_script(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE source GLOB 'src1*' OR source GLOB 'src[57]'")
def glob_source_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where(F.col("source").rlike(tx.glob_regex(["src1*", "src[57]"]))).select("doc_id", "source")


for _leak in ("leak_state", "leak_group", "leak_ngram"):

    def _one(spark: SparkSession, d: str, leak: str = _leak) -> DataFrame:
        return flagged(spark, d).where(F.col("leak") == leak).select("id", "source")

    _name = {"leak_state": "leak_exact"}.get(_leak, _leak)
    QUERIES[_name] = _one
    SQL[_name] = f"WITH {GUARD} SELECT id, src AS source FROM flagged WHERE leak = '{_leak}'"


@query(f"WITH {GUARD} SELECT df::BIGINT AS df, count(*)::BIGINT AS n FROM idx GROUP BY df")
def fp_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).prints.groupBy("df").agg(F.count("*").alias("n"))


@query(f"WITH {GUARD}, reasons AS (SELECT *, CASE WHEN length(norm) > 12000 THEN 'state_too_long' ELSE leak END AS r1 FROM flagged), alive AS (SELECT id, row_number() OVER (PARTITION BY norm ORDER BY id) AS rn FROM reasons WHERE r1 IS NULL), full_ AS (SELECT r.src, coalesce(r1, CASE WHEN rn > 1 THEN 'duplicate' END) AS reason FROM reasons r LEFT JOIN alive USING (id)) SELECT src AS source, reason, count(*)::BIGINT AS n FROM full_ WHERE reason IS NOT NULL GROUP BY 1, 2")
def drop_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = documents_as_train(spark, d)
    judged = guard.print_hits(rows, index_of(spark, d), "id", group="group_id", hex_prints=True)
    judged = judged.withColumn("reason", F.when(F.col("size") > 12000, "state_too_long").otherwise(guard.first_leak()))
    first = judged.where("reason is null").groupBy("h").agg(F.min("id").alias("first"))
    judged = judged.join(first, "h", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("id") > F.col("first"), "duplicate")))
    return report.ledger(rows.select("id", "source").join(judged.select("id", "reason"), "id"), ["source"], "reason")


@query(f"WITH {GUARD} SELECT lang, count(*)::BIGINT AS n FROM (SELECT lang FROM flagged WHERE leak IS NULL QUALIFY row_number() OVER (PARTITION BY norm ORDER BY id) = 1) GROUP BY lang")
def leak_free_by_lang(spark: SparkSession, d: str) -> DataFrame:
    rows = documents_as_train(spark, d)
    judged = guard.print_hits(rows, index_of(spark, d), "id", group="group_id", hex_prints=True)
    first = judged.where(guard.first_leak().isNull()).groupBy("h").agg(F.min("id").alias("id"))
    return rows.select("id", "lang").join(first, "id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id, text FROM documents EXCEPT ALL SELECT doc_id, text FROM (SELECT * FROM documents ORDER BY text))) = 0 AS equal, count(*)::BIGINT AS n FROM documents")
def frozen_digest_equal(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "documents").select("doc_id", "text")
    one, two = guard.digest(a, ["doc_id", "text"]), guard.digest(a.repartition(7, "text"), ["doc_id", "text"])
    return one.alias("x").join(two.alias("y"), how="cross").select(F.expr("x.n = y.n and x.a = y.a and x.b = y.b").alias("equal"), F.col("x.n").alias("n"))


_U0 = u_sql("doc_id", 0)
_BK = f"SELECT doc_id, source, {_U0} AS u FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY u, doc_id) <= "


@query(f"WITH small AS ({_BK} 5), large AS ({_BK} 9) SELECT count(*)::BIGINT AS small, (SELECT count(*) FROM large)::BIGINT AS large, (SELECT count(*) FROM (SELECT doc_id FROM small EXCEPT SELECT doc_id FROM large))::BIGINT AS outside FROM small")
def nested_subset_check(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source")
    small, large = sampling.bottom_k(docs, "source", "doc_id", 5), sampling.bottom_k(docs, "source", "doc_id", 9)
    outside = small.select("doc_id").exceptAll(large.select("doc_id"))
    return small.agg(F.count("*").alias("small")).join(large.agg(F.count("*").alias("large")), how="cross").join(outside.agg(F.count("*").alias("outside")), how="cross")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def read_limit_per_source(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_n(read(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 20)


@query(f"SELECT doc_id, source FROM ({_BK} 7)")
def bottomk_per_source(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bottom_k(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 7)


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("source")).agg(F.count("*").alias("n"))


def _quota_sql(cap: str, total: str) -> str:
    """The quotas by bisection, as a check on the closed form."""
    return f"""WITH RECURSIVE counts AS (SELECT lang || '/' || source AS source, count(*)::DOUBLE AS n FROM documents GROUP BY 1), t AS (SELECT {total} AS total, {cap} AS cap FROM counts),
b AS (SELECT source, n, least(n, cap) AS b FROM counts, t),
bis AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1e9::DOUBLE AS hi UNION ALL
 SELECT i + 1, CASE WHEN s <= (SELECT total FROM t) THEN mid ELSE lo END, CASE WHEN s <= (SELECT total FROM t) THEN hi ELSE mid END
 FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT sum(least(b, (bis.lo + bis.hi) / 2 * sqrt(n))) FROM b) AS s FROM bis) WHERE i < 100)
SELECT source, n::BIGINT AS n, CASE WHEN (SELECT sum(b) FROM b) <= total THEN floor(b) ELSE floor(least(b, lo * sqrt(n) + 1e-7)) END::BIGINT AS quota FROM b, t, (SELECT lo FROM bis ORDER BY i DESC LIMIT 1)"""


@query(_quota_sql("1e18::DOUBLE", "floor(sum(n) * 0.37)"))
def temperature_quotas(spark: SparkSession, d: str) -> DataFrame:
    counts = source_counts(spark, d)
    return sampling.quotas(counts, int(counts.agg(F.sum("n")).first()[0] * 0.37))


@query(_quota_sql("9.0::DOUBLE", "floor(sum(n) * 0.31)"))
def capped_quotas(spark: SparkSession, d: str) -> DataFrame:
    counts = source_counts(spark, d)
    return sampling.quotas(counts, int(counts.agg(F.sum("n")).first()[0] * 0.31), cap=9)


_W = f"CASE WHEN kind_ = 'long' THEN 3.0 ELSE 1.0 END"


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS kind_, (('0x' || substr(sha256('0:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY ln(u) / {_W} DESC, doc_id) <= 6")
def weighted_topq(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "n_chars")
    quota = docs.select("source").distinct().withColumn("quota", F.lit(6))
    return sampling.weighted_top(docs, quota, F.when(F.col("n_chars") > 1000, 3.0).otherwise(1.0), identity="doc_id").select("doc_id", "source")


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {u_sql('doc_id', 3)}, doc_id) AS rn FROM documents) ORDER BY rn, lang LIMIT 25")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_pick(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 25, 3)


_BROKEN = """broken AS (SELECT *, CASE WHEN h = 0 THEN 'odd' ELSE kind END AS kind2, CASE WHEN h = 1 THEN ['yes'] WHEN h = 2 THEN ['yes', ' '] ELSE options END AS options2,
 CASE WHEN h = 3 THEN [0.5, 0.2] WHEN h = 4 THEN [-1.0, 2.0] WHEN h = 5 THEN [1.0] ELSE target END::DOUBLE[] AS target2, CASE WHEN h = 6 THEN '  ' ELSE question END AS question2 FROM (SELECT *, case_id::BIGINT % 9 AS h FROM labelled))"""


def broken(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("case_id").cast("long") % 9
    df = labelled(spark, d)
    arr = lambda *x: F.array(*map(F.lit, x))
    return df.withColumns({"kind": F.when(h == 0, "odd").otherwise(F.col("kind")), "options": F.when(h == 1, arr("yes")).when(h == 2, arr("yes", " ")).otherwise(F.col("options")), "target": F.when(h == 3, arr(0.5, 0.2)).when(h == 4, arr(-1.0, 2.0)).when(h == 5, arr(1.0)).otherwise(F.col("target")), "question": F.when(h == 6, "  ").otherwise(F.col("question"))})


@query(f"""WITH {LABELLED}, {_BROKEN} SELECT coalesce(CASE WHEN kind2 NOT IN ('noul', 'choice', 'score') THEN 'bad_kind' WHEN len(options2) < 2 THEN 'lt2_options' WHEN len(target2) <> len(options2) THEN 'target_len_mismatch'
 WHEN len(list_filter(target2, lambda x: x < 0)) > 0 THEN 'bad_target_value' WHEN abs(list_sum(target2) - 1) > 1e-4 THEN 'target_not_normalised' WHEN trim(question2) = '' OR trim(state) = '' THEN 'empty_text' WHEN len(list_filter(options2, lambda o: trim(o) = '')) > 0 THEN 'empty_option' END, 'ok') AS reason, count(*)::BIGINT AS n FROM broken GROUP BY 1""")
def validate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return broken(spark, d).groupBy(F.coalesce(invalid(), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


_PARTS = """WITH per AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), sets AS (SELECT p_brand AS id, list(p_type ORDER BY p_type) AS options, list(CASE WHEN p_type LIKE '%BRASS%' OR p_type < 'F' THEN n::DOUBLE ELSE 0.0::DOUBLE END ORDER BY p_type) AS target FROM per GROUP BY p_brand)"""


def part_sets(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").cast("double").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("p_type", "n")))
    sets = per.groupBy(F.col("p_brand").alias("id")).agg(listed.alias("l"))
    return sets.select("id", F.transform("l", lambda s: s["p_type"]).alias("options"), F.transform("l", lambda s: F.when(F.contains(s["p_type"], F.lit("BRASS")) | (s["p_type"] < "F"), s["n"]).otherwise(0.0)).alias("target"))


@query(_PARTS + """, flat AS (SELECT id, options[i] AS o, target[i] AS t, i - 1 AS i FROM sets, unnest(range(1, len(options) + 1)) AS u(i)),
kept AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY id ORDER BY t <= 0, CASE WHEN t > 0 THEN '' ELSE sha256(concat_ws(':', '0', id, i)) END, i) <= 4)
SELECT k.id, string_agg(o, '|' ORDER BY i) AS options, count(*)::BIGINT AS n, (SELECT count(*) FROM flat f WHERE f.id = k.id AND t > 0) > 4 AS too_many FROM kept k GROUP BY k.id""")
def cap_options(spark: SparkSession, d: str) -> DataFrame:
    out = render.cap_options(part_sets(spark, d), 4)
    return out.select("id", F.array_join("options", "|").alias("options"), F.size("options").cast("long").alias("n"), F.col("too_many_targets").alias("too_many"))


@query(_PARTS + " SELECT id, CASE WHEN list_sum(target) > 0 THEN round(list_max(list_transform(target, lambda x: x / list_sum(target))), 6) END AS top, len(target)::BIGINT AS k FROM sets")
def normalise_targets(spark: SparkSession, d: str) -> DataFrame:
    return part_sets(spark, d).select("id", F.round(F.array_max(ar.normalise(F.col("target"))), 6).alias("top"), F.size("target").cast("long").alias("k"))


@query("WITH per AS (SELECT l_partkey, l_returnflag, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey, max(n) / sum(n) AS top FROM per GROUP BY 1) SELECT count(*)::BIGINT AS n, round(avg((top < 1 - 1e-6)::INT::DOUBLE), 6) AS soft FROM t")
def soft_share(spark: SparkSession, d: str) -> DataFrame:
    per = read(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").cast("double").alias("n")).groupBy("l_partkey").agg(F.collect_list("n").alias("t"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg(ar.is_soft(ar.normalise(F.col("t"))).cast("double")), 6).alias("soft"))


#: Licence names as documents give them, the form that each is to have, and what the policy says of it. Written out, so that the SQL is a table and not the rules once more.
LICENCES = (
    ("MIT License", "mit", "ok"),
    ("Apache License, Version 2.0", "apache-license,version-2.0", "not_on_allowlist"),
    ("MIT", "mit", "ok"),
    ("mit-license", "mit", "ok"),
    ("apache 2.0", "apache-2.0", "ok"),
    ("Apache-2.0", "apache-2.0", "ok"),
    ("Apache license 2", "apache-2.0", "ok"),
    ("CC BY 4.0", "cc-by-4.0", "ok"),
    ("cc-by-sa-4.0", "cc-by-sa-4.0", "share_alike"),
    ("Creative Commons BY-SA 3.0", "cc-by-sa-3.0", "share_alike"),
    ("CC0", "cc0-1.0", "ok"),
    ("cc-by-nc-4.0", "cc-by-nc-4.0", "non_commercial"),
    ("BSD 3 clause", "bsd-3-clause", "ok"),
    ("bsd-2-clause", "bsd-2-clause", "ok"),
    ("isc", "isc", "ok"),
    ("unknown", "unknown", "unknown_license"),
    ("", "", "unknown_license"),
    ("mit, apache-2.0", "mit,apache-2.0", "ok"),
    ("mit, other", "mit,other", "unknown_license"),
    ("mit (dpi)", "mit", "ok"),
    ("GPL-3.0", "gpl-3.0", "not_on_allowlist"),
    ("odc_by", "odc-by", "ok"),
    ("research only", "research-only", "non_commercial"),
)
_KNOWN = "known(l, canon, reason) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LICENCES) + ")"
_LIC = _KNOWN + r", lic AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?:Released|Licensed) under the ') THEN regexp_replace(regexp_extract(text, '(?:Released|Licensed) under the ([^\n]*)', 1), '\.$', '') ELSE (_NAMES_)[doc_id % _N_ + 1] END AS l FROM documents)".replace("_NAMES_", str([x[0] for x in LICENCES])).replace("_N_", str(len(LICENCES)))


def licence_rows(spark: SparkSession, d: str) -> DataFrame:
    """The licence that a document's text names, and for others a name by their ids."""
    named = F.col("text").rlike("(?:Released|Licensed) under the ")
    own = F.regexp_replace(F.regexp_extract("text", r"(?:Released|Licensed) under the ([^\n]*)", 1), r"\.$", "")
    other = F.get(F.array(*(F.lit(x[0]) for x in LICENCES)), (F.col("doc_id") % len(LICENCES)).cast("int"))
    return read(spark, d, "documents").select("doc_id", F.when(named, own).otherwise(other).alias("l"))


@query(f"WITH {_LIC} SELECT doc_id, l AS license, canon FROM lic JOIN known USING (l)")
def license_lines(spark: SparkSession, d: str) -> DataFrame:
    return licence_rows(spark, d).select("doc_id", F.col("l").alias("license"), licenses.normalise(F.col("l")).alias("canon"))


@query(f"WITH {_LIC} SELECT l AS license, reason, count(*)::BIGINT AS n FROM lic JOIN known USING (l) GROUP BY 1, 2")
def license_policy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Names are counted first, so each is read once."""
    counts = licence_rows(spark, d).groupBy(F.col("l").alias("license")).agg(F.count("*").alias("n"))
    return counts.select("license", licenses.reason(F.col("license")).alias("reason"), "n")


_UPS = "ups AS (SELECT p_brand AS subset, p_partkey AS place, CASE p_size % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'CC BY 4.0' WHEN 2 THEN 'apache 2.0' WHEN 3 THEN 'cc-by-sa-4.0' ELSE CASE WHEN p_partkey % 97 = 0 THEN 'cc-by-nc-4.0' ELSE 'isc' END END AS l, CASE WHEN p_partkey % 61 = 0 THEN 'qualified' ELSE 'verified' END AS status FROM part)"


@query(f"WITH {_KNOWN}, {_UPS}, r AS (SELECT ups.*, known.reason AS r0 FROM ups JOIN known USING (l)), r2 AS (SELECT *, CASE WHEN r0 IN ('ok', 'share_alike') AND status <> 'verified' THEN 'license_' || status ELSE r0 END AS why FROM r) SELECT subset, count(*) FILTER (WHERE why NOT IN ('ok', 'share_alike')) = 0 AS allowed, coalesce(arg_min(why, place) FILTER (WHERE why NOT IN ('ok', 'share_alike')), 'ok') AS reason, array_to_string(list_sort(list(DISTINCT l)), '; ') AS licenses FROM r2 GROUP BY subset")
def subset_license_all_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 5
    lic = F.when(k == 0, "MIT").when(k == 1, "CC BY 4.0").when(k == 2, "apache 2.0").when(k == 3, "cc-by-sa-4.0").when(F.col("p_partkey") % 97 == 0, "cc-by-nc-4.0").otherwise("isc")
    ups = read(spark, d, "part").select(F.col("p_brand").alias("subset"), F.col("p_partkey").alias("place"), lic.alias("license"), F.when(F.col("p_partkey") % 61 == 0, "qualified").otherwise("verified").alias("status"))
    return ingest.subset_licences(ups)


@query(f"WITH {LABELLED} SELECT id, source, split, question, target[1] AS yes FROM labelled")
def unpivot_labels(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("id", "source", "split", "question", F.get("target", F.lit(0)).alias("yes"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def json_props_explode(spark: SparkSession, d: str) -> DataFrame:
    entries = read(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("name", "k"))
    return entries.where("name = 'k'").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, round(CASE o_orderstatus WHEN 'F' THEN 0.7 WHEN 'O' THEN 0.2 ELSE 0.0 END::DOUBLE / 0.9, 6) AS p_f, round(CASE o_orderstatus WHEN 'F' THEN 0.2 WHEN 'O' THEN 0.7 ELSE 0.9 END::DOUBLE / 0.9, 6) AS p_o FROM orders")
def nested_targets_align(spark: SparkSession, d: str) -> DataFrame:
    """Gold maps whose keys may lack some of the criteria, aligned to the criteria's order."""
    gold = F.when(F.col("o_orderstatus") == "F", '{"q":{"probabilities":{"f":0.7,"o":0.2}}}').when(F.col("o_orderstatus") == "O", '{"q":{"probabilities":{"o":0.7,"f":0.2}}}').otherwise('{"q":{"probabilities":{"o":0.9}}}')
    rows = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("workflow"), F.lit('{"a":"b"}').alias("state"), F.lit('{"q":{"type":"choice","instructions":"which?","criteria":{"f":"first","o":"other"}}}').alias("questions"), gold.alias("gold"))
    out = ingest.json_columns(rows, "orders", "train").where("drop_reason is null")
    return out.select(F.col("case_id").cast("long").alias("id"), F.round(F.get("target", F.lit(0)), 6).alias("p_f"), F.round(F.get("target", F.lit(1)), 6).alias("p_o"))


@query("""WITH names AS (SELECT list_sort(list(DISTINCT event_type)) AS a FROM events), rows AS (SELECT event_id AS id, event_type AS intent, list_filter(a, lambda x: x <> event_type) AS others FROM events, names),
drawn AS (SELECT id, intent, o FROM (SELECT id, intent, unnest(others) AS o FROM rows) QUALIFY row_number() OVER (PARTITION BY id ORDER BY sha256(concat_ws(':', '0d', id, 'en-US', o)), o) <= 2),
whole AS (SELECT id, intent, o FROM drawn UNION ALL SELECT id, intent, intent FROM rows)
SELECT 'en-US:' || id AS id, string_agg(o, '|' ORDER BY sha256(concat_ws(':', '0o', id, 'en-US', o)), o) AS options, (list_position(list(o ORDER BY sha256(concat_ws(':', '0o', id, 'en-US', o)), o), any_value(intent)) - 1)::BIGINT AS gold FROM whole GROUP BY id""")
def distractor_options(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("train").alias("partition"), F.col("event_type").alias("intent"), F.col("props").alias("utt"))
    return ingest.intents(rows, "en-US", "train", 3).select("id", F.array_join("options", "|").alias("options"), ar.argmax(F.col("target")).cast("long").alias("gold"))


@query("SELECT conv_id, sha256(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS prompt, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id")
def conversation_prompt(spark: SparkSession, d: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("t"))))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(listed, lambda s: s["t"]), "\n"), 256).alias("prompt"), F.count("*").alias("turns"))
