"""op3 on groups of near copies around the threshold, with and without the text they come from, against brute force."""

import random

import numpy as np
import pytest

from quillon.llm import jaccard

from .test_operators import brute_join


def near_group(seed, n, base_too, length=70):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(50)}x{i}" for i in range(length)]
    rows = [(0, " ".join(base), "a")] if base_too else []
    for k in range(n):
        w = list(base)
        if k % 3 == 0:
            w[5] = "shared"  # a change that many have
        for _ in range(rng.randint(1, 7 if base_too else 4)):
            at = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.6:
                w[at] = f"e{rng.randrange(10**6)}" if rng.random() < 0.8 else f"few{rng.randrange(4)}"
            elif kind < 0.8:
                del w[at]
            else:
                w.insert(at, f"i{rng.randrange(10**6)}")
        rows.append((k + 1, " ".join(w), "a"))
    return rows


@pytest.mark.parametrize(("base_too", "small", "hints"), [(True, 2, 256), (False, 1, 16), (False, 512, 256)])
def test_groups_of_near_copies(spark, base_too, small, hints):
    rows = near_group(7, 160, base_too)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = jaccard.join(df, 4, 85, 100, small=small, hints=hints).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_join(rows, 4, 85, 100)
    assert sorted(map(tuple, got)) == want
    assert 10 < len({c for _, _, c in want}) < 150  # neither one component nor none


def test_differences_meet_for_every_link():
    """Linked sets are both linked to the pivot or share a hash of their cut differences at positions that add up to D at most."""
    m = jaccard.Measure(4, 85, 100)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64))
    pool = rng.integers(0, 1 << 62, 25).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(len(base), rng.integers(0, 16), replace=False)), rng.choice(pool, rng.integers(0, 16), replace=False)])) for _ in range(150)]
    p = sets[0]
    cut, size = jaccard._prefixes(m, p, sets, sets[::5])
    met = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not m.linked(a, b) or (m.linked(a, p) and m.linked(b, p)):
                continue
            both, x, y = np.intersect1d(cut[i], cut[j], return_indices=True)
            assert len(both) and (x + y).min() <= min(m.differ(len(s), m.most(len(s))) for s in (a, b))
            met += 1
    assert met > 50 and all(m.linked(a, p) == (n <= m.differ(len(a), len(p))) for a, n in zip(sets, size.tolist(), strict=True))
