"""The divergence audit, the language model and hard negatives against brute force, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import balltree, divergence, maxent

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(n=90, seed=3):
    rng = random.Random(seed)
    vocab = ["the", "of", "Æon", "straße", "ÉTÉ", "a_b", "x1y", "日本", "Ab", "aB"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(None, None, None, None), (1, "", "", "s0"), (2, " \n ", "en", None), (3, "the the the", "xx", "only"), (3, "the the the", "xx", "only"), (4, None, "zz", "s1"), (5, "of", "zz", "s0")]
    for i in range(n):
        rows.append((10 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de"]), f"s{rng.randint(0, 18)}"))
    rows.append((500, " ".join(rng.choice(vocab) for _ in range(20000)), "en", "s0"))
    return rows


def audit_by_hand(rows, least):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        ts = [t.translate(LOWER) for t in TERM.findall(text or "")]
        counts[g].update(ts)
        docs[g[0]].update(set(ts))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        peers = {s: Counter({t: counts[lang, s][t] for t in kept}) for x, s in groups if x == lang}

        def share(c, v=len(kept)):
            total = sum(c.values())
            return lambda t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v)

        p, q = share(peers[source]), share(sum(peers.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = sorted(((-sum(f(p(t), share(c)(t)) for t in kept), s.encode()) for s, c in peers.items() if s != source))
        terms = sorted((-f(p(t), q(t)), t.encode()) for t in kept if peers[source][t] > 0 and p(t) > q(t))[:10]
        out += [(lang, source, part, x.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, x) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least,seat", [(10, 8), (3, 2), (10**6, 3)])
def test_audit(spark, monkeypatch, least, seat):
    monkeypatch.setattr(divergence, "SEAT", seat)  # several seats, so that rounds and byes occur
    monkeypatch.setattr(divergence, "TERMS", 8)  # several blocks
    rows = documents()
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, term string, n long, seat int").repartition(3)
    found = sorted(tuple(r) for r in divergence.audit(df, least=least).collect())
    assert found == audit_by_hand(rows, least)
    if least == 10:
        assert divergence.audit(df.where("false")).count() == 0


def test_audit_cuts_long_texts_between_terms(monkeypatch):
    text = " ".join(f"Wört{chr(97 + i % 26)}" for i in range(500))

    def counts(size):
        monkeypatch.setattr(divergence, "SLICE", size)
        b = pa.RecordBatch.from_arrays([pa.array([text.encode(), None], pa.binary()), pa.array([b"en", b"en"]), pa.array([b"s", b"s"])], ["text", "lang", "source"])
        return sorted((r["term"] or b"", r["n"], r["docs"]) for out in divergence._counted([b]) for r in out.to_pylist())

    assert counts(7) == counts(1 << 20) and len(counts(64)) == 27


@pytest.mark.parametrize("seats", range(2, 12))
def test_all_seats_meet_once(spark, seats):
    turns = seats + seats % 2 - 1
    df = spark.range(seats).crossJoin(spark.range(turns).withColumnRenamed("id", "t")).select(F.col("id").cast("int").alias("i"), F.col("t").cast("int"), F.lit(seats).alias("n"))
    met = df.withColumn("j", divergence.opponent(F.col("i"), F.col("t"), F.col("n"))).where("j < i").collect()
    assert Counter((r["i"], r["j"]) for r in met) == Counter((i, j) for i in range(seats) for j in range(i))
    assert all(n == 1 for n in Counter((r["t"], x) for r in met for x in (r["i"], r["j"])).values())


def test_shares_are_exact_beyond_64_bits():
    count, total = np.array([0, 1, 3 * 10**12, 8 * 10**15 - 1]), 8 * 10**15
    assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // total for c in count]


def test_model_counts_base_and_scores(spark, monkeypatch):
    monkeypatch.setattr(maxent, "CHUNK", 3000)
    rows = [(None, None), (None, "alone"), (7, ""), (7, ""), (8, " \t\n")] + [(i, t) for i, t, *_ in documents(60)]
    df = spark.createDataFrame([(*r, 1, b"h", "w") for r in rows], "doc_id long, text string, n long, h binary, words string").repartition(2)
    found = maxent.score(df).collect()
    token = lambda t: [*[w.lower() if w.isascii() else w.translate(LOWER) for w in (t or "").replace(" ", "_").split()], None]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is not None, i or 0, out(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t)), 6)) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert maxent.score(df.where("false")).count() == 0


def test_model_without_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = maxent.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], abs(r["score"])) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    mass = rng.integers(0, 5, maxent.WIDTH**2) * rng.integers(0, 2, maxent.WIDTH**2)
    m = maxent.Model(mass.astype(float), int(mass.sum()), int((mass > 0).sum()), 3)
    h = [np.full(maxent.WIDTH**2, x, np.uint64) for x in (5, 77, 1234567)]
    leaf = np.arange(maxent.WIDTH**2, dtype=np.int32)
    for _ in range(30):
        m.learn(np.full(50, 33, np.int32), *(x[:50] for x in h))
    p = 10 ** m.log10(leaf, *h)
    assert p.sum() == pytest.approx(1, abs=1e-4) and p[33] > 10 * mass[33] / mass.sum()


def test_model_beats_the_base_on_held_out_documents(spark):
    r = maxent.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert r[2] > 50 and r[0] > 0.95 * r[1]  # log10 probabilities: nearer to 0 is better


def test_words_cut_by_slices(monkeypatch):
    text = ("Één woord " * 50 + "x" * 300 + " einde").encode()

    def tokens(size):
        monkeypatch.setattr(maxent, "SLICE", size)
        b = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text], pa.binary())], ["doc_id", "text"])
        r = next(iter(maxent._encoded([b]))).to_pylist()[0]
        return [r["words"][i] for i in maxent.loosen(r["ids"], r["sizes"][0], "<i4")]

    assert tokens(5) == tokens(64) == tokens(1 << 20) == [*re.sub(rb"[A-Z]", lambda x: x[0].lower(), text).split(), b""]


def negatives_by_hand(rows, scale=256):
    whole = [(i, label, np.floor(np.array(v, float) * scale).astype(int)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for *_, v in whole), default=0)
    whole = [(i, label, np.pad(v, (0, dim - len(v)))) for i, label, v in whole]
    out = []
    for a, (i, label, v) in enumerate(whole):
        if i % 50:
            continue
        scored = [(-int(w @ v), j, m) for b, (j, m, w) in enumerate(whole) if b != a]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = sorted((t, k) for t, k, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("shard,leaf", [(4096, 64), (16, 4)])
def test_hard_negatives(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(balltree, "SHARD", shard)
    monkeypatch.setattr(balltree, "LEAF", leaf)
    monkeypatch.setattr(balltree, "SUMMARIES", 5)
    rng = random.Random(4)
    bad = [(0, 1, None), (50, None, [1.0]), (None, 1, [1.0]), (100, 1, [1.0, None]), (150, 1, [float("nan")]), (200, 2, [float("inf"), 1.0]), (250, 2, [])]
    common = [0.5] * 6
    rows = bad + [(i, rng.randint(0, 3), common if i % 3 == 0 else [rng.uniform(-0.2, 1) for _ in range(6)]) for i in range(300, 620)]
    rows += rows[-30:] + [(300, 0, common), (350, 3, [0.1, 0.2])]  # repeated rows, two rows of one id, a short vector
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, shard string, rid long").repartition(3)
    df = df.withColumn("embedding", F.expr("transform(embedding, x -> cast(x as double))"))
    exact = [(i, label, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert sorted(tuple(r) for r in balltree.mine(df).collect()) == negatives_by_hand(exact)
    assert balltree.mine(df.where("false")).count() == 0


def test_ball_bounds_prune():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 1000
    v = np.concatenate([c + rng.normal(size=(100, 16)) * 20 for c in centres]).astype(np.int64)
    tree = balltree.Tree(np.arange(4000), np.arange(4000), v)
    q = v[::40]
    s = q @ v.T
    best, who = np.full((len(q), 3), balltree.LOW), np.full((len(q), 3), balltree.NONE)
    hi = s.max(axis=1) * 9 // 10
    tree.search(q, hi // 2, hi, np.full(len(q), -1), best, who)
    s[(s > hi[:, None]) | (s < hi[:, None] // 2)] = balltree.LOW
    order = np.lexsort((np.broadcast_to(np.arange(4000), s.shape), -s), axis=1)[:, :3]
    want = np.take_along_axis(s, order, axis=1)
    assert (best == want).all() and (np.where(want > balltree.LOW, who == order, who == balltree.NONE)).all()
    assert tree.looked < 0.25 * tree.possible


def test_vectors_too_long_for_exact_scores(spark):
    with pytest.raises(ValueError, match="62 bits"):
        balltree.mine(spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1e9])], "vec_id long, label int, embedding array<double>"))
