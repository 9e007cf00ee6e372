"""The queries of this package over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, chat, divergence, html_text, jaccard, line_chunks, maxent, mixing, mtree, passages, pieces, quality, wavelet
from .common import table


def vocabulary_file(name: str) -> str:
    """Where an installed public vocabulary lies; the operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_chunks.mark(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", F.col("n_lines_").alias("n_lines"), F.col("n_removed_").alias("n_removed"), F.sha2("text_", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, trees)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), vocabulary_file("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.col("copies").cast("long").alias("copies"), F.round(F.get("positions", F.lit(0)), 9).alias("first_position"))


def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op13_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return balltree.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS u(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id AS d, j FROM again, unnest(range(i, i + 35)) AS u(j)),
words AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE j IS NULL) AS kept, count(*) AS n, count(j) AS removed
  FROM words LEFT JOIN gone ON d = doc_id AND j = p GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, max(a.n) AS na, max(b.n) AS nb FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS reached FROM sets UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.reached)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, count(*) OVER (PARTITION BY CASE WHEN len(s.s) = 0 THEN [s.doc_id::VARCHAR, ''] ELSE list_sort(s.s) END)::BIGINT AS n_copies
FROM sets s JOIN (SELECT node, min(reached) AS component_id FROM reach GROUP BY node) c ON c.node = s.doc_id
"""

OP5_SQL = r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, list_transform(ls, lambda l: ('0x' || substr(md5(l), 1, 8))::BIGINT) AS hs, len(ls) AS n FROM lines),
ended AS (SELECT *, list_filter(range(1, n + 1), lambda i: i = n OR (hs[i] + 31 * (CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) + 961 * (CASE WHEN i > 2 THEN hs[i - 2] ELSE 0 END)) % 4 = 0) AS ends FROM hashed),
chunks AS (SELECT doc_id, text, k, ls[(CASE WHEN k > 1 THEN ends[k - 1] + 1 ELSE 1 END):ends[k]] AS c FROM ended, unnest(range(1, len(ends) + 1)) AS u(k)),
multi AS (SELECT *, array_to_string(c, chr(10)) AS chunk FROM chunks WHERE len(c) > 1 AND len(list_filter(c, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) > 1),
ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) AS r FROM multi),
left_over AS (SELECT c.doc_id, string_agg(array_to_string(c.c, chr(10)), chr(10) ORDER BY c.k) FILTER (WHERE coalesce(r.r, 1) = 1) AS kept,
  sum(len(c.c)) AS n_lines, coalesce(sum(len(c.c)) FILTER (WHERE r.r > 1), 0) AS n_removed
  FROM chunks c LEFT JOIN ranked r USING (doc_id, k) GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN left_over USING (doc_id)
"""

OP9_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM sized GROUP BY source),
weighed AS (SELECT *, (rk % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM per),
filled AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS c_here FROM weighed),
level AS (SELECT arg_min(c_here, cap / w) AS c FROM filled WHERE c_here * w <= cap),
targets AS (SELECT source, rk, source_size, CASE WHEN c IS NULL THEN cap ELSE least(cap, c * w) END AS target FROM filled, (SELECT max(c) AS c FROM level)),
keyed AS (SELECT s.doc_id, s.size, t.*, md5(concat_ws(':', '7', s.doc_id)) AS h, (s.size * 200 <= t.target)::INT AS rest FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY rk ORDER BY rest, h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS middle FROM keyed),
taken AS (SELECT *, CASE WHEN size > 0 THEN greatest(0, least(3, floor((target - middle) / source_size) + 1)) ELSE 0 END::BIGINT AS copies, (rk % 3 - 1) * 0.5::DOUBLE AS ramp, least(1.0::DOUBLE, middle / target) AS y FROM placed)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
  CASE WHEN copies > 0 THEN round(2 * y / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * y)), 9) END AS first_position
FROM taken
"""

OP10_SQL = r"""
WITH whole AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP11_SQL = r"""
WITH words AS (SELECT doc, lang, source, unnest(ts) AS term FROM (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents)),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n_lang)::BIGINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ((1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v))::BIGINT AS p,
    1 + ((1000000000::HUGEINT * (k.n_lang + 2)) // (l.total + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.rid, a.vec_id AS anchor_id, a.label, c.rid AS other, c.vec_id, c.label AS other_label, list_inner_product(a.v, c.v)::BIGINT AS score FROM whole a JOIN whole c ON a.vec_id % 50 = 0 AND a.rid <> c.rid),
positives AS (SELECT rid, other, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = other_label QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.rid, p.other ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.rid = p.rid AND s.label <> s.other_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.rid, p.other ORDER BY score DESC, vec_id) <= 3
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet": op1_wavelet,
    "op2_passages": op2_passages,
    "op3_jaccard": op3_jaccard,
    "op4_chat_repair": op4_chat_repair,
    "op5_line_chunks": op5_line_chunks,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_pieces": op8_pieces,
    "op9_mixing": op9_mixing,
    "op10_mtree": op10_mtree,
    "op11_divergence": op11_divergence,
    "op12_maxent": op12_maxent,
    "op13_balltree": op13_balltree,
}

SQL: dict[str, str] = {"op2_passages": OP2_SQL, "op3_jaccard": OP3_SQL, "op5_line_chunks": OP5_SQL, "op9_mixing": OP9_SQL, "op10_mtree": OP10_SQL, "op11_divergence": OP11_SQL, "op13_balltree": OP13_SQL}
