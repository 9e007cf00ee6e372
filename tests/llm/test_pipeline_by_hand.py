"""run(), stage by stage, against plain Python (and for the mix DuckDB) on the smallest table with planted copies, nulls and repeated rows."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quillon.llm import pieces, quality
from quillon.llm.queries import OP9_SQL, vocabulary_file

from .test_operators import brute_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and the rows after each stage, and run()'s rows over the same tables."""
    root = tmp_path_factory.mktemp("tables")
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = [r for r in given.orderBy("doc_id").limit(60).collect() if r["text"] and len(r["text"].split()) > 80][:4]
    more = [(10_000 + i, r["text"] + (" and a tail" if i % 2 else ""), r["lang"], r["source"], len(r["text"])) for i, r in enumerate(some * 3)]
    more += [(20_000, None, "en", "src0", 0), (20_001, "", "en", None, 0), (20_002, "few words here", "en", "src1", 14)]
    docs = given.union(spark.createDataFrame(more, given.schema)).repartition(3)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{root}/labels.parquet")
    out, docs = [spark.read.parquet(f"{root}/documents.parquet")], None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], str(root)).write.parquet(f"{root}/stage{i}.parquet")
        out.append(spark.read.parquet(f"{root}/stage{i}.parquet"))
    return root, [[r.asDict() for r in df.collect()] for df in out], [r.asDict() for r in corpus_pipeline.run(spark, str(root)).collect()]


def pairs(rows):
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def test_quality_keeps_what_the_trees_and_the_base_rule_keep(spark, stages):
    root, rows, _ = stages
    docs = spark.read.parquet(f"{root}/documents.parquet")
    trees = quality.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
    verdict = {r["doc_id"]: r for r in quality.judge(docs, trees).collect()}
    assert pairs(rows[1]) == pairs(r for r in rows[0] if verdict[r["doc_id"]]["kept"])
    for r in rows[0]:
        words = WORD.findall(r["text"] or "")
        threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert verdict[r["doc_id"]]["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
    assert 0 < len(rows[1]) < len(rows[0])


def without_repeated_chunks(rows):
    """Chunks end where a rolling hash of three line hashes is divisible by 4; of a chunk of two lines or more with words in two, its first place stays."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        lines, kept, chunk = r["text"].split("\n"), [], []
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        for i, line in enumerate(lines):
            chunk.append(line)
            rolled = hashes[i] + 31 * (hashes[i - 1] if i > 0 else 0) + 961 * (hashes[i - 2] if i > 1 else 0)
            if i + 1 == len(lines) or rolled % 4 == 0:
                key = "\n".join(chunk)
                if len(chunk) < 2 or sum(bool(WORD.search(x)) for x in chunk) < 2 or key not in seen:
                    kept += chunk
                    seen.add(key)
                chunk = []
        out.append((r["doc_id"], "\n".join(kept)))
    return sorted(out)


def test_lines(stages):
    _, rows, _ = stages
    assert pairs(rows[2]) == without_repeated_chunks(rows[1])


def test_near_duplicates_leave_one_of_each_component(stages):
    _, rows, _ = stages
    found = brute_join([(r["doc_id"], r["text"], None) for r in rows[2]], 5, 80, 100)
    least = {i: component for i, _, component in found}
    assert pairs(rows[3]) == pairs(r for r in rows[2] if least[r["doc_id"]] == r["doc_id"])
    assert len(rows[3]) < len(rows[2])


def test_mix_takes_the_planned_copies(stages):
    root, rows, _ = stages
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/stage2.parquet/*.parquet')")
    plan = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({OP9_SQL})").fetchall()}
    assert Counter(r["doc_id"] for r in rows[4]) == Counter({i: n for i, n in plan.items() if n})
    texts = {r["doc_id"]: r["text"] for r in rows[3]}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows[4])


def test_pieces_decode_to_the_texts_and_run_gives_the_same_rows(stages):
    _, rows, run = stages
    v = pieces.vocabulary(vocabulary_file("piece_bpe_32k.model"))
    assert all(pieces.decode(v, list(r["piece_ids"])) == r["text"] for r in rows[5])
    key = lambda some: sorted((r["doc_id"], r["text"], tuple(r["piece_ids"])) for r in some)
    assert key(run) == key(rows[5]) and pairs(rows[5]) == pairs(rows[4])
