"""A worker that has encoded a task's texts keeps none of its parts: later stages' tasks run in it."""

from types import SimpleNamespace

import pyarrow as pa

from quillon.llm import pieces
from quillon.llm.queries import vocabulary_file


def test_parts_go_with_the_task():
    shared = SimpleNamespace(value=pieces.vocabulary(vocabulary_file("piece_bpe_32k.model")))
    batch = pa.RecordBatch.from_arrays([pa.array(["some words of a text", None, ""])], names=["text"])
    pieces._memos.clear()
    for _ in range(2):
        out = [b.column("piece_ids").to_pylist() for b in pieces._ids(shared, 0)(iter([batch]))]
        assert len(out) == 1 and out[0][0] and out[0][1:] == [[], []]
        assert not pieces._memos
