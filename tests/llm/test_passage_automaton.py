"""op2 finds passages by its automaton: without what it finds nothing is removed."""

import numpy as np

from quillon.llm import passages
from quillon.llm.wordhash import Words

from .test_operators import brute_passages, corpus


def test_phrases_are_found_where_they_stand():
    rng = np.random.default_rng(2)
    words = [f"w{x}".encode() for x in rng.integers(0, 6, 4000)]
    w = Words([b"  ".join(words[:1500]), None, b"\n".join(words[1500:])])
    phrases = [b" ".join(words[a : a + 8]) for a in (0, 17, 1500, 3900)]
    want = [i for i in range(4000 - 7) if b" ".join(words[i : i + 8]) in phrases]
    assert sorted(passages.located(w.hashes(), phrases).tolist()) == want and len(want) >= 4
    assert not len(passages.located(w.hashes(), [])) and not len(passages.located(w.hashes()[:0], phrases))


def test_shard_needs_what_the_automaton_finds(monkeypatch):
    import pyarrow as pa

    rows = [(i, t) for i, t, _ in corpus() if i is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["shard", "doc_id", "text"])
    packs = pa.Table.from_batches(list(passages._pack(iter([batch]))))
    anchors = pa.Table.from_batches(list(passages._anchor_rows(1)(iter([batch.select(["shard", "text"])]))))
    confirmed = passages._confirmed(passages._window_rows(1)(packs, passages._recurring(anchors)))
    out = passages._locate(packs, confirmed)
    want = brute_passages([(i, t, None) for i, t in rows])
    assert sorted((r["doc_id"], r["n_removed"]) for r in out.to_pylist()) == sorted((d, n) for d, _, n, _ in want) and sum(n for _, _, n, _ in want) > 100
    monkeypatch.setattr(passages, "located", lambda h, phrases: np.zeros(0, np.int64))
    assert sum(passages._locate(packs, confirmed)["n_removed"].to_pylist()) == 0
