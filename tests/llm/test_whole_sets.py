"""op3 makes whole sets only of classes that sketches leave, however many phrases unrelated texts share."""

import random

import numpy as np

from quillon.llm import jaccard

from .test_operators import brute_join


def phrased(n=120, phrases=40, words=160):
    """Unrelated texts that share phrases of four words, and near copies of every tenth."""
    rng = random.Random(11)
    common = [" ".join(f"p{k}w{i}" for i in range(4)) for k in range(phrases)]
    rows = []
    for k in range(n):
        parts = [f"t{k}x{i}" for i in range(words)]
        for p in rng.sample(common, 25):
            parts.insert(rng.randrange(len(parts)), p)
        rows.append((2 * k, " ".join(parts), "a"))
        if k % 10 == 0:
            rows.append((2 * k + 1, " ".join(parts[:-1]), "a"))
    return rows


def test_sets_of_few_classes_are_made(spark, monkeypatch):
    rows, made = phrased(), []

    def written(df, name, *by, f=jaccard.written):
        out = f(df, name, *by)
        if name == "jaccard-sets":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", written)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_join(rows, 4, 85, 100)
    assert made and all(n <= 40 for n in made)  # 24 are near copies or have one, of 132


def test_keys_are_of_the_largest_segments():
    """Sets that share single hashes alone, in one order of keys, have few keys in common."""
    rng = np.random.default_rng(2)
    plan = jaccard.Plan(jaccard.Measure(4, 85, 100), frozenset(), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    pool = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 200).astype(np.uint64), pool])) for _ in range(40)]
    given = [plan.chosen(s) for s in sets]
    met = sum(len(np.intersect1d(a, b)) > 0 for i, a in enumerate(given) for b in given[:i])
    assert met < 200  # of 780 pairs
