"""Queries on mixtures: quotas under family caps, boosts for floors and caps, and nested named sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling, selection
from .relations import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CAPS = {"ones": 0.1, "fr": 0.08}
_PATTERNS = {"ones": "en/src1*"}


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Documents as decisions of three kinds by length and two or three options by language; a language and source is a source."""
    docs = read(spark, d, "documents")
    kind = F.when(F.col("n_chars") > 2500, "score").when(F.col("n_chars") > 1500, "noul").otherwise("choice")
    options = F.when(F.col("lang") == "en", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.concat_ws("/", "lang", "source").alias("source"), F.col("lang").alias("dataset"), kind.alias("kind"), options.alias("options"))


_POOL = """pool AS (SELECT doc_id::VARCHAR AS id, lang || '/' || source AS source, CASE WHEN lang = 'en' AND source LIKE 'src1%' THEN 'ones' ELSE lang END AS family,
 CASE WHEN n_chars > 2500 THEN 'score' WHEN n_chars > 1500 THEN 'noul' ELSE 'choice' END AS kind, lang = 'en' AS two,
 ln((('0x' || substr(sha256('0:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS p FROM documents),
counts AS (SELECT source, family, count(*) AS n FROM pool GROUP BY ALL)"""


def fill_sql(name: str, rows: str, target: str) -> str:
    """Common tables that find the level by bisection: name has (source, q)."""
    return f"""{name}_in AS ({rows}), {name}_level AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1e7::DOUBLE AS hi UNION ALL
 SELECT i + 1, CASE WHEN s <= {target} THEN mid ELSE lo END, CASE WHEN s <= {target} THEN hi ELSE mid END
 FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT sum(least(b, (x.lo + x.hi) / 2 * w)) FROM {name}_in) AS s FROM {name}_level x) WHERE i < 110),
{name} AS (SELECT source, CASE WHEN (SELECT sum(b) FROM {name}_in) <= {target} OR lo * w >= b + 1e-6 THEN floor(b) ELSE greatest(0, least(floor(b), floor(lo * w - 1e-9))) END::BIGINT AS q FROM {name}_in, (SELECT lo FROM {name}_level ORDER BY i DESC LIMIT 1))"""


def family_sql(name: str, counts: str, total: str, share: float | None, caps: dict[str, float]) -> str:
    """Common tables; name has (source, family, n, q). Each cap's own quotas, then a round for each cap and one more."""
    bound = "n::DOUBLE" if share is None else f"least(n, floor({total} * {share}))::DOUBLE"
    out = [f"{name}_base AS (SELECT source, family, n, {bound} AS b, sqrt(n::DOUBLE) AS w FROM {counts})"]
    for f, cap in caps.items():
        out.append(fill_sql(f"{name}_own_{f}", f"SELECT source, b, w FROM {name}_base WHERE family = '{f}'", f"({total} * {cap}::DOUBLE)"))
    out.append(f"{name}_own AS (" + " UNION ALL ".join(f"SELECT source, '{f}' AS family, q FROM {name}_own_{f}" for f in caps) + ")")
    out.append(f"{name}_caps AS (" + " UNION ALL ".join(f"SELECT '{f}' AS family, {total} * {cap}::DOUBLE AS cap" for f, cap in caps.items()) + ")")
    out.append(f"{name}_held0 AS (SELECT '' AS family WHERE false)")
    for i in range(len(caps) + 1):
        held = f"(SELECT family FROM {name}_held{i})"
        left = f"greatest(0, {total} - (SELECT coalesce(sum(q), 0) FROM {name}_own WHERE family IN {held}))"
        out.append(fill_sql(f"{name}_free{i}", f"SELECT source, b, w FROM {name}_base WHERE family NOT IN {held}", left))
        if i < len(caps):
            out.append(f"{name}_held{i + 1} AS (SELECT family FROM {name}_held{i} UNION SELECT family FROM {name}_free{i} JOIN {name}_base USING (source) JOIN {name}_caps USING (family) GROUP BY family, cap HAVING sum(q) > cap)")
    last = len(caps)
    out.append(f"{name} AS (SELECT source, family, n, q FROM {name}_base JOIN (SELECT source, q FROM {name}_free{last} UNION ALL SELECT source, q FROM {name}_own WHERE family IN (SELECT family FROM {name}_held{last})) USING (source))")
    return ",\n".join(out)


_HALF = "(SELECT floor(sum(n) * 0.5) FROM counts)"


@query(f"WITH RECURSIVE {_POOL}, {family_sql('fq', 'counts', _HALF, None, _CAPS)} SELECT source, family, n::BIGINT AS n, q AS quota FROM fq")
def family_capped_quotas(spark: SparkSession, d: str) -> DataFrame:
    counts = pool(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.min("dataset").alias("dataset"))
    counts = counts.withColumn("family", sampling.family(F.col("source"), F.col("dataset"), _PATTERNS)).drop("dataset")
    from pyspark.sql import Window

    return selection.family_quotas(counts, F.floor(F.sum("n").over(Window.partitionBy()) * 0.5), _CAPS)


def boosts_sql(quota: str, floors: dict[str, float], most: float, rounds: int) -> str:
    """Common tables comp{i} and lever{i}: each round selects anew from the pool and moves the levers."""
    levers = ", ".join(f"1.0::DOUBLE AS b_{k}" for k in floors)
    out = [f"lever0 AS (SELECT {levers}, 1.0::DOUBLE AS pen)"]
    weight = "(CASE " + " ".join(f"WHEN kind = '{k}' THEN b_{k}" for k in floors) + " ELSE 1.0 END * CASE WHEN two AND kind <> 'noul' THEN pen ELSE 1.0 END)"
    for i in range(rounds + 1):
        out.append(f"sel{i} AS (SELECT pool.*, row_number() OVER (PARTITION BY source ORDER BY p / {weight} DESC, id) AS rank, q FROM pool JOIN {quota} USING (source), lever{i} QUALIFY rank <= q)")
        out.append(f"comp{i} AS (SELECT count(*) AS n, avg((kind = 'noul')::INT::DOUBLE) AS noul, avg((kind = 'score')::INT::DOUBLE) AS score, avg((kind = 'choice')::INT::DOUBLE) AS choice, avg(two::INT::DOUBLE) AS two_share FROM sel{i})")
        if i < rounds:
            up = [f"CASE WHEN {k} < {f} - 0.004 OR ({k} > {f} + 0.004 AND b_{k} > 1) THEN least(200.0, greatest(1.0, b_{k} * pow({f}::DOUBLE / greatest({k}, 1e-4), 0.8::DOUBLE))) ELSE b_{k} END AS b_{k}" for k, f in floors.items()]
            down = f"CASE WHEN two_share > {most} + 0.004 OR (two_share < {most} - 0.004 AND pen < 1) THEN least(1.0, greatest(0.01, pen * pow({most}::DOUBLE / greatest(two_share, 1e-4), 0.8::DOUBLE))) ELSE pen END AS pen"
            out.append(f"lever{i + 1} AS (SELECT {', '.join(up)}, {down} FROM lever{i}, comp{i})")
    return ",\n".join(out)


_FLOORS, _MOST, _ROUNDS = {"noul": 0.2, "score": 0.35}, 0.36, 5
_OK = " AND ".join(f"({k} >= {f} - 0.008)" for k, f in _FLOORS.items()) + f" AND two_share <= {_MOST} + 0.008"


@query(f"""WITH RECURSIVE {_POOL}, {family_sql('fq', 'counts', _HALF, None, _CAPS)}, {boosts_sql('fq', _FLOORS, _MOST, _ROUNDS)}
SELECT n::BIGINT AS n, round(noul, 9) AS noul, round(score, 9) AS score, round(choice, 9) AS choice, round(two_share, 9) AS binary, round(b_noul, 9) AS boost_noul, round(b_score, 9) AS boost_score, round(pen, 9) AS penalty, ({_OK}) AS within
FROM comp{_ROUNDS}, lever{_ROUNDS}""")
def boosted_composition(spark: SparkSession, d: str) -> DataFrame:
    """The composition that five rounds of the solver reach, read from the summaries."""
    rows = pool(spark, d)
    quota = family_capped_quotas(spark, d)
    summary = selection.summaries(rows, quota)
    solved = selection.solve_boosts(summary, _FLOORS, _MOST, _ROUNDS)
    out = selection.composed(summary, solved.boosts, solved.penalty)
    shares = [F.round(c, 9).alias(c) for c in ("noul", "score", "choice", "binary")]
    within = [F.col(k) >= f - 0.008 for k, f in _FLOORS.items()] + [F.col("binary") <= _MOST + 0.008]
    return out.select("n", *shares, *(F.round(F.lit(solved.boosts[k]), 9).alias(f"boost_{k}") for k in _FLOORS), F.round(F.lit(solved.penalty), 9).alias("penalty"), (within[0] & within[1] & within[2]).alias("within"))


#: A mixture in which everything binds: six tenths of the pool, sources held to 2 % and families to their caps.
_SHARE, _NAMED = 0.02, {"mid": 0.4, "small": 0.2}
_TOTAL = "(SELECT floor(sum(n) * 0.6) FROM counts)"


def _sized(name: str, share: float) -> str:
    return family_sql(name, "(SELECT source, family, q AS n FROM full_q)", f"(SELECT floor(sum(n) * {share}) FROM counts)", _SHARE, _CAPS)


_V1 = f"WITH RECURSIVE {_POOL}, {family_sql('full_q', 'counts', _TOTAL, _SHARE, _CAPS)}, {boosts_sql('full_q', _FLOORS, _MOST, 3)}, {', '.join(_sized(k, v) for k, v in _NAMED.items())}"


def _v1(spark: SparkSession, d: str) -> tuple:
    rows = pool(spark, d)
    n = rows.count()
    sizes = selection.Sizes(total=int(n * 0.6), max_source_share=_SHARE, families=_PATTERNS, family_caps=_CAPS, kind_floors=_FLOORS, max_binary=_MOST, sizes={k: int(n * v) for k, v in _NAMED.items()}, rounds=3)
    return *selection.mixture(rows, sizes), sizes


@query(f"{_V1} SELECT id, source, rank::INT AS rank, concat_ws(',', CASE WHEN rank <= mid.q THEN 'mid' END, CASE WHEN rank <= small.q THEN 'small' END) AS sizes FROM sel3 JOIN mid USING (source) JOIN small USING (source)")
def mixture_v1(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the full mixture, and which of the nested sizes hold each."""
    return _v1(spark, d)[0].select("id", "source", F.col("rank").cast("int").alias("rank"), F.concat_ws(",", "sizes").alias("sizes"))


@query(f"{_V1} SELECT source, full_q.family, full_q.n::BIGINT AS n, full_q.q AS quota, mid.q AS mid, small.q AS small FROM full_q JOIN mid USING (source) JOIN small USING (source)")
def mixture_v1_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _v1(spark, d)[1]


@query(f"""{_V1}, m AS (SELECT sel3.*, mid.q AS qm, small.q AS qs FROM sel3 JOIN mid USING (source) JOIN small USING (source)),
e AS (SELECT 'full' AS size, * FROM m UNION ALL SELECT 'mid', * FROM m WHERE rank <= qm UNION ALL SELECT 'small', * FROM m WHERE rank <= qs)
SELECT size, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources, round(avg((kind = 'noul')::INT::DOUBLE), 9) AS noul, round(avg((kind = 'score')::INT::DOUBLE), 9) AS score, round(avg((kind = 'choice')::INT::DOUBLE), 9) AS choice, round(avg(two::INT::DOUBLE), 9) AS binary FROM e GROUP BY size""")
def mixture_v1_report(spark: SparkSession, d: str) -> DataFrame:
    out = selection.report(_v1(spark, d)[0], selection.Sizes())
    return out.select("size", "n", "sources", *(F.round(c, 9).alias(c) for c in ("noul", "score", "choice", "binary")))
