"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces and their log scores come from a model file (a parameter). A text is normalised by a leading marker and markers
for spaces; the best path maximises the sum of scores, ties go to the longer last piece, and a character that no piece
covers becomes its bytes' pieces at the price of the lowest score less 10. As no piece has a marker after another
character (checked when the model is read; else whole texts are searched), the path of a text is that of its
marker-led parts, and a line feed that no piece has parts it too; distinct parts are searched once per worker.

Defined cases: a null or empty text has no ids and decodes to the empty text; the marker character itself in a text
stands for a space and comes back as one; repeated rows are encoded alike; further columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, given_back, held, need, release

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Texts that are returned together, and parts of texts that a worker remembers (in each of two generations).
ROWS, PARTS = 1024, 150_000


@dataclass
class Vocabulary:
    """What encoding and decoding need; base, check and value are the double array over UTF-8 bytes."""

    base: list[int]
    check: list[int]
    value: list[int]
    score: list[float]
    bytes_ids: list[int]
    surface: list[bytes]
    unknown: float
    parts: bool
    line_feed: bool
    key: str


def double_array(keys: list[tuple[bytes, int]]) -> tuple[list[int], list[int], list[int]]:
    """(base, check, value) of a trie of keys: the child of node s by byte c is t = base[s] + c with check[t] == s."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, at in keys:
        node = 0
        for c in key:
            nxt = children[node].get(c)
            if nxt is None:
                nxt = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = nxt
        ends[node] = at
    size = 2 * len(children) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    free = roomy = 257  # past every byte, so that a base is at least 1; where a lone child goes, and where several are tried first; neither goes back
    stack = [(0, 0)]
    value[0] = ends[0]
    while stack:
        node, slot = stack.pop()
        if not children[node]:
            base[slot] = 0
            continue
        cs = sorted(children[node])
        while check[free] != -1:
            free += 1
        b = max(1, (free if len(cs) == 1 else max(free, roomy)) - cs[0])
        tries = 0
        while True:
            if b + 260 >= len(base):
                more = len(base)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            if all(check[b + c] == -1 for c in cs):
                break
            b += 1
            tries += 1
        if tries > 64:
            roomy = b + cs[0]
        base[slot] = b
        for c in cs:
            check[b + c] = slot
            value[b + c] = ends[children[node][c]]
            stack.append((children[node][c], b + c))
    last = max(i for i, c in enumerate(check) if c != -1 or i == 0) + 260
    return base[:last] + [0] * 260, check[:last] + [-1] * 260, value[:last] + [-1] * 260


def vocabulary(path: str) -> Vocabulary:
    """Reads the pieces and scores of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = len(model)
    names = [model.id_to_piece(i) for i in range(n)]
    usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in range(n)]
    base, check, value = double_array([(names[i].encode(), i) for i in usual])
    bytes_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    surface = [b"" if model.is_control(i) else names[i].encode() for i in range(n)]
    for b, i in enumerate(bytes_ids):
        surface[i] = bytes([b])
    inner = any(MARK in names[i].lstrip(MARK) for i in usual)
    return Vocabulary(base, check, value, scores, bytes_ids, surface, min(scores[i] for i in usual) - UNKNOWN_PENALTY, not inner, any("\n" in names[i] for i in usual), path)


def best_path(v: Vocabulary, text: bytes) -> list[int]:
    """The ids of the best path through normalised text."""
    base, check, value, score = v.base, v.check, v.value, v.score
    n = len(text)
    best: list[float | None] = [None] * (n + 1)
    came, by = [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    i = 0
    while i < n:
        c = text[i]
        width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        so_far, node, j, single = best[i], 0, i, False
        while j < n:
            t = base[node] + text[j]
            if check[t] != node:
                break
            node = t
            j += 1
            k = value[node]
            if k >= 0:
                now = so_far + score[k]
                old = best[j]
                if old is None or now > old:
                    best[j], came[j], by[j] = now, i, k
                if j - i == width:
                    single = True
        i += width
        if not single:
            now = so_far + v.unknown
            old = best[i]
            if old is None or now > old:
                best[i], came[i], by[i] = now, i - width, -1
    ids: list[int] = []
    while n > 0:
        a = came[n]
        if by[n] >= 0:
            ids.append(by[n])
        else:
            ids += [v.bytes_ids[b] for b in reversed(text[a:n])]
        n = a
    return ids[::-1]


_memos: dict[str, tuple[Memo, Memo]] = {}


def encoder(v: Vocabulary):
    """text -> ids as little-endian 32-bit integers."""
    if v.key not in _memos:
        make = lambda lead: Memo(lambda part: np.array(best_path(v, (lead + part).encode("utf-8", "surrogatepass")), "<u4").tobytes(), PARTS)
        _memos[v.key] = make(MARK), make("")
    marked, plain = (m.__getitem__ for m in _memos[v.key])
    feed = np.array(v.bytes_ids[10:11], "<u4").tobytes()

    def whole(text: str) -> bytes:
        return np.array(best_path(v, text.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def line(text: str, first: bool) -> bytes:
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            head = (marked if first else plain)(parts[0])
            return head + b"".join(map(marked, parts[1:])) if len(parts) > 1 else head
        out, run = [], int(first)
        for i, p in enumerate(parts):
            run += i > 0
            if p:
                out.append(plain(MARK * run + p))
                run = 0
        if run:
            out.append(plain(MARK * run))
        return b"".join(out)

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if not v.parts:
            return whole(MARK + text.replace(" ", MARK))
        if v.line_feed:
            return line(text, True)
        return feed.join([line(x, i == 0) if x or i == 0 else b"" for i, x in enumerate(text.split("\n"))])

    return encode


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces and bytes joined, markers as spaces, without the leading one."""
    text = b"".join(map(v.surface.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text[:1] == " " else text


_DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])


def _digest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encode = encoder(v)
        is_byte = np.zeros(len(v.surface), bool)
        is_byte[v.bytes_ids] = True
        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py() or ""
                raw = encode(text)
                ids = np.frombuffer(raw, "<u4")
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(raw), decode(v, ids.tolist()) == text.replace(MARK, " ")))
            n, k, crc, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=_DIGEST.names)

    return run


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes every whole text: its number of pieces, those of single bytes, the ids' crc32, and whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))  # as large as the vocabulary file, whatever the input
    return need(docs, doc_id=T.LongType(), text=T.StringType()).mapInArrow(_digest(shared), _DIGEST)


def _ids(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        try:
            for batch in batches:
                for k in range(0, max(1, batch.num_rows), ROWS):
                    b = batch.slice(k, ROWS)
                    raw = [encode(t.as_py()) for t in b.column(at)]
                    ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                    ids = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=[*b.schema.names, "piece_ids"])
                release()
        finally:  # the worker goes on to other stages' tasks, which need the memory
            encode = None
            _memos.clear()
            release()

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs with piece_ids, in place of a column of that name if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))
    docs = docs.drop("piece_ids")
    rows = held(docs)
    found = rows.mapInArrow(_ids(shared, docs.columns.index("text")), T.StructType([*rows.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))
    return found.select(*given_back(docs), "piece_ids")
