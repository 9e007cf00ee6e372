"""Operators against brute force, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, html_text, jaccard, line_chunks, mixing, mtree, passages, pieces, quality, wavelet
from quillon.llm.components import components
from quillon.llm.queries import vocabulary_file

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, source string, size long, key_ string, h string, shard long, component long"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 1, "k", "h", 2, 3) for i, t, s in rows], COLUMNS)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    said = " ".join(rng.choice(vocab) for _ in range(60))
    rows = [(None, "lonely text here", "a"), (1000, None, None), (1001, "", "b"), (1002, " \n\t ", "a"), (1003, "two words", "a"), (1003, "two words", "a")]
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 9)))
        if i % 4 == 0:
            text += "\n" + said
        if i % 7 == 0 and i:
            text = rows[-1][1]
        if i % 11 == 0 and i:
            text = rows[-1][1] + " tail"
        rows.append((i, text, f"s{i % 3}"))
    rows.append((2000, " ".join(rng.choice(vocab) for _ in range(30000)), "s0"))
    return rows


@pytest.fixture(scope="module")
def some(spark):
    rows = corpus()
    return rows, docs(spark, rows).persist()


def test_wavelet_files(spark, some):
    from tokenizers import Tokenizer

    rows, df = some
    path = vocabulary_file("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    found = wavelet.round_trip(df, path, shard_tokens=5000).collect()
    start = 0
    for r, (i, t, _) in zip(sorted(found, key=lambda r: r["start"]), sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.round_trip(df.where("false"), path).count() == 0


def test_wavelet_queries():
    ids = np.random.default_rng(0).integers(0, 900, 200_000).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids, np.array([7]), np.array([True]), np.array([len(ids)]), 0, 16))
    assert (w.tokens() == ids).all() and all(w.access(i) == ids[i] for i in (0, 65535, 65536, 199_999))
    for t in (int(ids[5]), 899, 5000, 70000):
        at = np.flatnonzero(ids == t)
        assert w.count(t) == len(at) and w.rank(t, 100_000) == (at < 100_000).sum() and list(w.occurrences(t))[:3] == at[:3].tolist()


@pytest.mark.parametrize("text", ["  a b", "a  b\n c", "\n\nx  \n", "a b 　c  ", "it's  'd x's", "a \x85b", "1234 56  7", "x <|endoftext|> y", "\U0001f389 日本 語"])
def test_pieces_of_text_are_encoded_as_the_whole(text):
    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    assert np.frombuffer(wavelet.ids_of(path)(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def brute_passages(rows, n=35):
    words = [SPLIT.findall(t or "") for _, t, _ in rows]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + n))
    return sorted((r[0] if r[0] is not None else -1, len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for r, w, g in zip(rows, words, gone, strict=True))


@pytest.mark.parametrize("shard_bytes", [1 << 23, 20_000])
def test_passages(some, shard_bytes):
    rows, df = some
    found = passages.dedup(df, shard_bytes=shard_bytes).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, found)) == brute_passages(rows)
    assert passages.dedup(df.where("false")).count() == 0


def brute_join(rows, n, num, den):
    sets = []
    for _, t, _ in rows:
        w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, len(s), least.get(root(i), -1) if s else (r[0] if r[0] is not None else -1)) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(seed=3):
    rng = random.Random(seed)
    rows = [(5000, "Only Three words", "a"), (5001, "only three WORDS", "a"), (5002, None, "a"), (5003, "", "a")]
    for g in range(4):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(rng.choice([9, 40, 150]))]
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(w), "a"))
    return rows


@pytest.mark.parametrize(("n", "num", "sample"), [(4, 85, 16384), (5, 80, 8)])
def test_jaccard_components(spark, n, num, sample):
    rows = near_rows()
    found = jaccard.join(docs(spark, rows), n, num, 100, sample).select(F.coalesce("doc_id", F.lit(-1)), "n_shingles", F.coalesce("component_id", F.lit(-1))).collect()
    assert sorted(map(tuple, found)) == brute_join(rows, n, num, 100)


def test_pigeonhole_meets_every_link():
    """Sets at the bound share a key, for both allocations."""
    rng = np.random.default_rng(5)
    m = jaccard.Measure(4, 85, 100)
    for thin in (frozenset(), frozenset(range(6))):
        plan = jaccard.Plan(m, thin, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for size in [*range(6, 40), 100, 333]:
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            for lost in range(len(a)):
                new = rng.integers(0, 1 << 63, max(0, lost - int(rng.integers(0, 2)))).astype(np.uint64)
                b = np.unique(np.concatenate([a[lost:], new]))
                if not m.linked(a, b):
                    break
                assert (a.tobytes() == b.tobytes()) or len(np.intersect1d(plan.chosen(a), plan.chosen(b)))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and len(got) == 33
    assert components(df.where("false")).count() == 0


def cheapest(roles):
    """The cost of the best repair by dynamic programming over whole histories."""
    best = {0: 0}
    for r in roles:
        nxt = {}
        for s, c in best.items():
            for t, (cost, action) in enumerate(chat.step(chat.code(r))[s]):
                if action:
                    nxt[t] = min(nxt.get(t, 1 << 60), c + cost)
        best = nxt
    return min(c + chat.END[s] for s, c in best.items())


def test_chat_repair(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "hello"]), "x") for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(["user", "assistant"]), "y", "x") for t in range(700)] + [(None, 0, "user", "z", "x"), (None, None, "user", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk string")
    legal = re.compile(r"(<\|im_start\|>system\n[^<]*<\|im_end\|>\n)?((<\|im_start\|>user\n[^<]*<\|im_end\|>\n)(<\|im_start\|>assistant\n[^<]*<\|im_end\|>\n))*\Z")
    by = {}
    for r in chat.repair(df, chunk=64).collect():
        by.setdefault(r["conv_id"], []).append(r)
    for c, found in by.items():
        found.sort(key=lambda r: (r["turn"] is None, r["turn"] or 0))
        assert legal.match("".join(r["rendered"] for r in found))
        assert {r["conv_cost"] for r in found} == {cheapest([r["role"] for r in found])}
    assert sum(map(len, by.values())) == len(rows) and chat.repair(df.where("false")).count() == 0


def test_line_chunks_keep_first_places(spark, some):
    rows, df = some
    out = {(r["doc_id"], r["text"]): r for r in line_chunks.mark(df).collect()}
    for (_, text), r in out.items():
        if text is None:
            assert r["text_"] is None and r["n_removed_"] == 0
        else:
            left = r["text_"].split("\n") if r["text_"] or not r["n_removed_"] else []
            assert len(left) + r["n_removed_"] == len(text.split("\n")) and r["n_lines_"] == len(text.split("\n"))
    block = "one two\nthree four\nfive six\nseven eight\nnine ten\neleven\ntwelve x\nthirteen y\nfour teen"
    two = docs(spark, [(1, block, "a"), (2, "new first line\n" + block, "a"), (3, block, "a"), (3, block, "a")])
    kept = {r["doc_id"]: r for r in line_chunks.mark(two, 2).collect()}
    assert kept[1]["n_removed_"] == 0 and kept[2]["n_removed_"] >= 4 and kept[3]["n_removed_"] >= 4
    assert line_chunks.dedup(two.where("false")).columns == two.columns


def test_quality_statistics_and_constraints(spark):
    rng = random.Random(4)
    for _ in range(30):
        w = [rng.choice("ab c# d".split()) + rng.choice(["", "x"]) for _ in range(rng.randint(0, 60))]
        text = " ".join(w) + "\nq\nq\n" * rng.randint(0, 2)
        found = SPLIT.findall(text)
        tri, cover = {}, set()
        for i in range(len(found) - 2):
            tri.setdefault(tuple(found[i : i + 3]), []).append(i)
        for places in tri.values():
            if len(places) > 1:
                cover |= {p + k for p in places for k in range(3)}
        lines = [x for x in text.split("\n") if SPLIT.search(x)]
        assert quality.statistics(text)[0] == [len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)]
    x = np.random.default_rng(0).random((2000, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.6).astype(float)
    trees = quality.train(x[:1500], y[:1500], (1, 0, -1))
    assert ((trees.score(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.93
    step = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.4), np.full(50, 0.5)])
    assert (np.diff(trees.score(step)) >= -1e-12).all() and quality.train(x, np.ones(2000), (0, 0, 0)) is None


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    trees = quality.fit(all_docs, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(all_docs, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select((F.col("score") > 0).alias("s"), "quality").collect()
    assert sum(r["s"] == bool(r["quality"]) for r in judged) / len(judged) > 0.95
    odd = docs(spark, corpus(n=3))
    assert quality.judge(odd, None).where("kept").count() == quality.keep_good(odd, None).count() and quality.judge(odd.where("false"), trees).count() == 0


def test_html(spark):
    nav = "<nav><ul><li><a href='/a'>menu</a></ul></nav>"
    side = "<div><p>Site line</p><p>Every page has this</p></div>"
    pages = [(i, f"http://h.example/{i}", f"<html><body>{nav}{side}<div><h1>T{i}</h1><p>own text {i}<b> bold<p>more &amp; {i}</div></body>") for i in range(30)]
    pages += [(100, "http://h.example/x", "<body><header>no</header><article><h1>Head</h1>a<br>b<div class='comments'>c</div><script>if(a<b)'</p>'</script><form>f</form><p>d&nbsp;e</article>"), (101, None, "<p>x"), (102, "bad", None), (103, "http://q.example/", "")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[4]["text"] == "T4\n\nown text 4 bold\n\nmore & 4" and got[100]["text"] == "Head\n\na b\n\nd e" and got[101]["text"] == "x" and got[102]["text"] == got[103]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    salted = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), broadcast_hosts=0, salts=3).collect()
    assert {r["page_id"]: r["text"] for r in salted} == {k: r["text"] for k, r in got.items()}


def test_pieces_by_brute_force():
    v = pieces.vocabulary(vocabulary_file("piece_bpe_32k.model"))
    scores = {s: v.score[i] for i, s in enumerate(v.surface) if i not in v.bytes_ids and s}
    for text in ("▁the▁cat", "▁▁▁a", "▁naïve日", "x" * 20):
        best = {0: 0.0}
        for end in range(1, len(text) + 1):
            ways = [best[a] + scores[text[a:end].encode()] for a in range(end) if text[a:end].encode() in scores]
            if text[end - 1].encode() not in scores:
                ways.append(best[end - 1] + v.unknown)
            best[end] = max(ways)
        ids = pieces.best_path(v, text.encode())
        at, total, raw = 0, 0.0, text.encode()
        for i in ids:
            total += v.score[i] if i not in v.bytes_ids else 0.0
            at += len(v.surface[i])
        total += v.unknown * sum(1 for c in text if c.encode() not in scores)
        assert at == len(raw) and b"".join(v.surface[i] for i in ids) == raw and abs(total - best[len(text)]) < 1e-6


def test_pieces_round_trip(spark, some):
    _, df = some
    path = vocabulary_file("piece_bpe_32k.model")
    assert pieces.digest(df, path).where("not round_trip").count() == 0
    v = pieces.vocabulary(path)
    for t in ("  a b", "a  b\n c", "\n\nx  \n", "日本 🎉", " "):
        ids = np.frombuffer(pieces.encoder(v)(t), "<u4").tolist()
        assert pieces.decode(v, ids) == t and ids == pieces.best_path(v, ("▁" + t.replace(" ", "▁")).encode())
    assert pieces.encode(df, path).columns == [*df.columns, "piece_ids"]


def test_mixing(spark, some):
    rows, df = some
    got = mixing.plan(df).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted((x for x in by if x is not None), key=str))}
    weights[None] = 1 + len(weights) % 3
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    left, open_, target = float(sum(sizes.values())), set(by), {}
    while True:
        c = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if c * weights[s] > 3 * sizes[s]}
        target |= {s: c * weights[s] for s in open_}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    for s, v in by.items():
        assert abs(v[0]["target"] - target[s]) < 1e-6 and abs(sum(r["taken"] for r in v) - target[s]) <= max(r["size"] for r in v)
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got) and mixing.plan(df.where("false")).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).round(2)], "x") for i in range(500)] + [(1000 + i, [0.5] * 8, "x") for i in range(150)]
    rows += [(2000, None, "x"), (2100, [1.0, None] + [0.0] * 6, "x"), (2200, [float("nan")] * 8, "x"), (2300, [float("inf")] * 8, "x"), (400, rows[400][1], "x"), (None, [1.0] * 8, "x"), (2400, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string")
    good = {i: [int(np.floor(x * 1024)) for x in v] + [0] * (8 - len(v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = sorted((q, k + 1, i, s) for q in good if q % 100 == 0 for k, (s, i) in enumerate(sorted(((int(np.dot(good[q], v)), i) for i, v in good.items() if i != q), key=lambda x: (-x[0], x[1]))[:10]))
    assert sorted(map(tuple, mtree.top_k(df).collect())) == want
    assert mtree.top_k(df.where("false")).count() == 0 and mtree.top_k(df.limit(1)).count() == 0


def test_tree_avoids_comparisons():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 6))
    v = (centres[rng.integers(0, 40, 6000)] + rng.integers(-20, 20, (6000, 6))).astype(np.int64)
    tree = mtree.Tree(np.arange(6000), v, float((v**2).sum(axis=1).max()))
    found = tree.search(np.array([10**6]), v[:1], 10)[0]
    s = v @ v[0]
    assert [(-a, i) for a, i in found] == sorted(zip(s.tolist(), range(6000), strict=True), key=lambda x: (-x[0], x[1]))[:10] and tree.compared < 3000
