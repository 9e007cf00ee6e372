"""Minimum-cost role repair of conversations, and their rendering.

Legal is: an optional system turn, then user and assistant turns in alternation, the last by the assistant. Each turn is
either a message of its own, under its role or relabelled, with empty messages put before it where the order needs them,
or merged into the message before it. The cheapest repair is a shortest path over the automaton of last roles; a turn is
a min-plus matrix over its four states, so a conversation is split by turn number into chunks whose matrices are
multiplied apart, and only matrices of one conversation meet. Each chunk is then repaired between the two states that
the whole conversation's best path has at its ends.

A turn's piece of the rendered text closes the message before it if it opens one, and the last turn closes the rest:
a conversation's pieces, in order, are its rendering.

Defined cases: turns go by number (without one: last), then role, then text; a null text is empty; a null or unknown
role costs a relabelling whatever it becomes; turns without a conversation id are one conversation; repeated rows are
turns of their own and merge; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, written

MERGE, RELABEL, INSERT = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
NEVER = 1 << 40
CHUNK = 256  # turn numbers a chunk
#: The empty messages that stand between a last role and a new one.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: The empty messages that end a conversation.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def step(role: int) -> list[list[tuple[int, str]]]:
    """For a turn of a role (START: unknown), [last role][next role] -> (cost, action)."""
    out = []
    for s in range(4):
        row = []
        for t in range(4):
            change = 0 if role == t else RELABEL
            ways = [(INSERT * len(BETWEEN[s, t]) + change, "keep" if role == t else "relabel")] if (s, t) in BETWEEN else []
            if s == t != START:
                ways.append((MERGE + change, "merge"))
            row.append(min(ways, default=(NEVER, "")))
        out.append(row)
    return out


STEPS = [step(r) for r in range(4)]
COSTS = [[[c for c, _ in row] for row in m] for m in STEPS]
END = [INSERT * len(CLOSING[s]) for s in range(4)]


def code(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES[1:] else START


def times(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def path(roles: list[int], enter: int, leave: int) -> list[int]:
    """The last roles after each turn of the cheapest way from one state to another; ties go to the lower role at the latest turn where ways differ."""
    costs = [[0 if s == enter else NEVER for s in range(4)]]
    for r in roles:
        last, m = costs[-1], COSTS[r]
        costs.append([min(last[s] + m[s][t] for s in range(4)) for t in range(4)])
    states = [leave]
    for i in range(len(roles) - 1, 0, -1):
        m, t = COSTS[roles[i]], states[-1]
        states.append(min(range(4), key=lambda s: (costs[i][s] + m[s][t], s)))
    return states[::-1]


def message(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n<|im_end|>\n"


_IN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_MATRIX = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("m", T.ArrayType(T.LongType()))])
_ENDS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("enter", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("last", T.BooleanType()), T.StructField("cost", T.LongType())])
_OUT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("new_role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("inserted", T.LongType()), T.StructField("conv_cost", T.LongType()), T.StructField("rendered", T.StringType())])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, a list for each value of the first columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _emit(rows: Iterator[tuple], schema: T.StructType, kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=schema.names)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for run in _runs(batches, 2):
            m = COSTS[code(run[0][3])]
            for r in run[1:]:
                m = times(m, COSTS[code(r[3])])
            yield run[0][0], run[0][1], [c for row in m for c in row]

    yield from _emit(rows(), _MATRIX, [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for run in _runs(batches, 1):
            ms = [[m[i : i + 4] for i in range(0, 16, 4)] for _, _, m in run]
            costs = [[0, NEVER, NEVER, NEVER]]
            for m in ms:
                costs.append([min(costs[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
            at = min(range(4), key=lambda s: (costs[-1][s] + END[s], s))
            total, states = costs[-1][at] + END[at], [at]
            for i in range(len(ms) - 1, -1, -1):
                states.append(min(range(4), key=lambda s: (costs[i][s] + ms[i][s][states[-1]], s)))  # noqa: B023
            states.reverse()
            for i, r in enumerate(run):
                yield r[0], r[1], states[i], states[i + 1], i == len(run) - 1, total

    yield from _emit(rows(), _ENDS, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for run in _runs(batches, 2):
            _, _, _, _, _, enter, leave, final, cost = run[0]
            states = path([code(r[3]) for r in run], enter, leave)
            before = enter
            for i, (r, now) in enumerate(zip(run, states, strict=True)):
                action = STEPS[code(r[3])][before][now][1]
                text = r[4] or ""
                put: tuple[int, ...] = ()
                if action == "merge":
                    piece = "\n" + text
                else:
                    put = BETWEEN[before, now]
                    piece = ("<|im_end|>\n" if before != START else "") + "".join(map(message, put)) + f"<|im_start|>{ROLES[now]}\n{text}"
                if final and i == len(run) - 1:
                    put += CLOSING[now]
                    piece += "<|im_end|>\n" + "".join(map(message, CLOSING[now]))
                yield r[0], r[2], r[3], ROLES[now], action, len(put), cost, piece
                before = now

    yield from _emit(rows(), _OUT, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each turn: conv_id, turn, role, new_role, action, inserted (empty messages), conv_cost and its piece of the rendered conversation."""
    rows = need(turns, conv_id=T.LongType(), turn=T.LongType(), role=T.StringType(), text=T.StringType()).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit((1 << 62)))).select(*_IN.names)
    order = ["conv_id", "chunk", F.col("turn").asc_nulls_last(), "role", "text"]
    roles = rows.withColumn("text", F.lit(None).cast("string"))
    matrices = roles.repartition("conv_id", "chunk").sortWithinPartitions(*order).mapInArrow(_matrices, _MATRIX)
    ends = written(matrices.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_ends, _ENDS), "chat-ends")
    met = rows.join(ends.withColumnsRenamed({"conv_id": "c_", "chunk": "k_"}), F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("chunk") == F.col("k_")))
    return met.select(*_IN.names, "enter", "leave", "last", "cost").repartition("conv_id", "chunk").sortWithinPartitions(*order).mapInArrow(_repair, _OUT)

