"""Token-id output as wavelet matrices: one compressed file for each run of documents in ascending id order.

A file holds its documents' ids and lengths and, for each bit of the token ids from the highest down, a bit plane in
blocks of 2^16 bits, each compressed by itself, with the ones before each block. Access, rank, select, counting and
occurrence lookup read only the blocks they touch; a whole file decodes plane by plane with numpy.

Defined cases: a null or empty text has only the end id; documents without an id come first; rows with the same id are
ordered by text; an empty table writes no file and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, put_file, scratch
from .wordhash import runs

MAGIC = b"QWM1"
HEAD = struct.Struct("<4sIQQQ")  # magic, width, tokens, documents, tokens of this partition before the file
PLANE = struct.Struct("<QI")  # zeros, blocks
BLOCK = 1 << 16


def _pack(values: np.ndarray) -> bytes:
    raw = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())
    return struct.pack("<I", len(raw)) + raw


def build(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, before: int, width: int) -> bytes:
    """The bytes of a file for the concatenated ids of the documents."""
    out = [HEAD.pack(MAGIC, width, len(ids), len(doc_ids), before), _pack(doc_ids.astype("<i8")), _pack(known.astype(np.uint8)), _pack(lengths.astype("<u4"))]
    press = zstandard.ZstdCompressor(level=1)
    level = ids.astype(np.uint16 if width <= 16 else np.uint32)
    for bit in range(width - 1, -1, -1):
        ones = (level & level.dtype.type(1 << bit)) != 0
        packed = np.packbits(ones, bitorder="little")
        parts = [press.compress(packed[i : i + BLOCK // 8].tobytes()) for i in range(0, len(packed), BLOCK // 8)]
        sums = np.array([np.bitwise_count(packed[i : i + BLOCK // 8]).sum(dtype=np.int64) for i in range(0, len(packed), BLOCK // 8)], np.int64)
        zeros = len(ones) - int(sums.sum())
        out.append(PLANE.pack(zeros, len(parts)))
        out.append((np.cumsum(sums) - sums).astype("<u8").tobytes())
        out.append(np.cumsum([0, *map(len, parts)]).astype("<u4").tobytes())
        out += parts
        deeper = np.empty_like(level)
        np.compress(~ones, level, out=deeper[:zeros])
        np.compress(ones, level, out=deeper[zeros:])
        level = deeper
    return b"".join(out)


class WaveletMatrix:
    """A file's bytes, opened: ``access``, ``rank``, ``select``, ``count`` and ``occurrences`` read single blocks; ``tokens`` decodes it all."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, docs, self.before = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.data, at, found = data, HEAD.size, []
        for kind in ("<i8", np.uint8, "<u4"):
            (size,) = struct.unpack_from("<I", data, at)
            found.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 4 : at + 4 + size]), kind))
            at += 4 + size
        self.doc_ids, self.known, self.lengths = found[0], found[1].astype(bool), found[2].astype(np.int64)
        assert len(self.doc_ids) == docs
        self.planes = []
        for _ in range(self.width):
            zeros, blocks = PLANE.unpack_from(data, at)
            at += PLANE.size
            before = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
            at += 8 * blocks
            ends = np.frombuffer(data, "<u4", blocks + 1, at).astype(np.int64)
            at += 4 * (blocks + 1)
            self.planes.append((zeros, before, ends + at))
            at += int(ends[-1])
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._blocks:
            ends = self.planes[plane][2]
            raw = zstandard.ZstdDecompressor().decompress(self.data[ends[k] : ends[k + 1]])
            self._blocks[plane, k] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self._blocks[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        _, before, _ = self.planes[plane]
        k = min(i // BLOCK, len(before) - 1)
        return int(before[k]) + int(self._block(plane, k)[: i - k * BLOCK].sum()) if len(before) else 0

    def access(self, i: int) -> int:
        """The token at position i."""
        token = 0
        for p in range(self.width):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK])
            ones = self._ones(p, i)
            i = self.planes[p][0] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before position end stand below the last plane."""
        a, b = 0, end
        for p in range(self.width):
            oa, ob = self._ones(p, a), self._ones(p, b)
            a, b = (self.planes[p][0] + oa, self.planes[p][0] + ob) if token >> (self.width - 1 - p) & 1 else (a - oa, b - ob)
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before position end."""
        if token >> self.width or not self.n:
            return 0
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, plane: int, want: int, one: bool) -> int:
        """The position of the want-th (from 0) one or zero of a plane."""
        _, before, _ = self.planes[plane]
        starts = before if one else np.arange(len(before)) * BLOCK - before
        k = int(np.searchsorted(starts, want, side="right")) - 1
        bits = self._block(plane, k)[: self.n - k * BLOCK]
        return k * BLOCK + int(np.flatnonzero(bits if one else bits == 0)[want - int(starts[k])])

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for p in range(self.width - 1, -1, -1):
            one = bool(token >> (self.width - 1 - p) & 1)
            i = self._find(p, i - self.planes[p][0] if one else i, one)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def tokens(self) -> np.ndarray:
        """All token ids, in order: the planes undone from the lowest up."""
        level = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        undo = zstandard.ZstdDecompressor()
        for p in range(self.width - 1, -1, -1):
            zeros, _, ends = self.planes[p]
            raw = b"".join(undo.decompress(self.data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(level)
            up[np.flatnonzero(~ones)] = level[:zeros]
            up[np.flatnonzero(ones)] = level[zeros:] | level.dtype.type(1 << (self.width - 1 - p))
            level = up
        return level


_encoders: dict[tuple[str, bool], Encoder] = {}
#: Bytes that may follow a space at which a text is parted: not white space, nor what starts a white-space character beyond ASCII.
_PLAIN = np.ones(256, bool)
_PLAIN[:33] = False
_PLAIN[[0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Bytes of text that are encoded together.
AT_ONCE = 8 << 20
#: Parts that a worker remembers.
MOST = 1 << 21
#: Parts that the library is given as one text.
TOGETHER = 64


class Encoder:
    """The tokenizers library's own encode, without special tokens added, of many texts at once.

    The byte-level pattern always parts a text before a space that a non-space follows, so the ids of a text are those of
    its parts. Distinct parts are found by numpy and the library encodes each that isn't remembered once: parts that start
    with such a space together, as one text, whose ids fall to the parts by the bytes that each token stands for. Texts
    with the string of an added token, or whose bytes aren't UTF-8, are encoded whole by the library.
    """

    def __init__(self, path: str, ordinary: bool = False):
        """ordinary: strings of added tokens are ordinary text."""
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.own.encode_special_tokens = ordinary
        self.added = [t.content.encode() for t in self.own.get_added_tokens_decoder().values() if t.content and not ordinary]
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a byte is one character there
        # What is remembered of parts: two hashes (sorted by the first), and where their ids lie in all ids.
        self.one = self.two = np.zeros(0, np.uint64)
        self.offset = self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.own.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")

    def _learn(self, one: np.ndarray, two: np.ndarray, parts: list[bytes], keep: np.ndarray) -> None:
        """Remembers the ids of further parts, which ascend by hash; beyond MOST only with those in keep."""
        led = np.array([len(x) > 1 and x[0] == 32 and bool(_PLAIN[x[1]]) for x in parts], bool)
        some = [x for x, m in zip(parts, led.tolist(), strict=True) if m]
        joined = self.own.encode_batch_fast([b"".join(some[i : i + TOGETHER]).decode() for i in range(0, len(some), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in joined]) if some else self.flat[:0]
        ends = np.cumsum([len(x) for x in some], dtype=np.int64)
        at = np.cumsum(self.bytes_of[ids])
        cut = np.minimum(np.searchsorted(at, ends) + 1, len(at))
        if len(some) and (at[-1] != ends[-1] or (at[cut - 1] != ends).any()):  # a token crosses parts, which the pattern excludes
            each = [self.whole(x) for x in some]
            ids, cut = np.concatenate(each), np.cumsum([len(x) for x in each])
        others = self.own.encode_batch_fast([x.decode() for x, m in zip(parts, led.tolist(), strict=True) if not m], add_special_tokens=False)
        rest = [np.array(x.ids, "<u4") for x in others]
        length = np.empty(len(parts), np.int64)
        length[led] = np.diff(cut, prepend=0)
        length[~led] = [len(x) for x in rest]
        offset = np.empty(len(parts), np.int64)
        offset[led] = np.cumsum(length[led]) - length[led]
        offset[~led] = len(ids) + np.cumsum(length[~led]) - length[~led]
        flat = np.concatenate([ids, *rest])
        if len(self.one) + len(one) > MOST:
            self.one, self.two, old, n = self.one[keep], self.two[keep], self.offset[keep], self.length[keep]
            self.offset, self.length = np.cumsum(n) - n, n
            self.flat = self.flat[np.arange(int(n.sum())) + np.repeat(old - self.offset, n)]
        place = np.searchsorted(self.one, one)
        self.offset, self.length = np.insert(self.offset, place, offset + len(self.flat)), np.insert(self.length, place, length)
        self.one, self.two, self.flat = np.insert(self.one, place, one), np.insert(self.two, place, two), np.concatenate([self.flat, flat])

    def _found(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes among the remembered ones, whether each is there)."""
        if not len(self.one):
            return np.zeros(len(one), np.int64), np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return at, (self.one[at] == one) & (self.two[at] == two)

    def _special(self, texts: list[bytes]) -> list[int]:
        """The texts that are encoded whole."""
        joined = b"\n".join(texts)
        hits = any(a in joined for a in self.added)
        try:
            joined.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        if not hits and valid:
            return []

        def odd(t: bytes) -> bool:
            try:
                t.decode()
            except UnicodeDecodeError:
                return True
            return any(a in t for a in self.added)

        return [i for i, t in enumerate(texts) if odd(t)]

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has)."""
        raw = [t or b"" for t in texts]
        apart = {i: self.whole(raw[i]) for i in self._special(raw)}
        for i in apart:
            raw[i] = b""
        ids, counts = self._parted(raw)
        if apart:
            split = np.split(ids, np.cumsum(counts)[:-1])
            split = [apart.get(i, x) for i, x in enumerate(split)]
            ids, counts = np.concatenate(split), np.array([len(x) for x in split], np.int64)
        return ids, counts

    def _parted(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(raw)
        data, sizes = np.frombuffer(joined, np.uint8), np.array([len(x) for x in raw], np.int64)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(raw), np.int64)
        ends = np.cumsum(sizes)
        begin = np.zeros(len(data), bool)
        begin[:-1] = (data[:-1] == 32) & _PLAIN[data[1:]]
        begin[ends[sizes > 0] - 1] = False
        begin[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begin)
        stops = np.append(starts[1:], len(data))
        one, two = runs(data, starts, stops, 0), runs(data, starts, stops, 1)
        distinct, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[first][inverse]).any():  # two parts under one hash
            each = [self.whole(x) for x in raw]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        at, there = self._found(distinct, two[first])
        if not there.all():
            new = first[~there]
            parts = [joined[a:e] for a, e in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]
            self._learn(distinct[~there], two[new], parts, at[there])
            at, there = self._found(distinct, two[first])
            if not there.all():  # a remembered part has the same first hash
                self.one = self.one[:0]
                each = [self.whole(x) for x in raw]
                return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        flat, length, offset = self.flat, self.length[at], self.offset[at]
        each = length[inverse]
        total = np.cumsum(each)
        ids = flat[np.arange(total[-1]) + np.repeat(offset[inverse] - (total - each), each)]
        upto = np.searchsorted(starts, ends)  # parts of the texts up to each
        counts = np.diff(np.concatenate([[0], np.concatenate([[0], total])[upto]]))
        return ids, counts


def encoder_of(path: str, ordinary: bool = False) -> Encoder:
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = Encoder(path, ordinary)
    return _encoders[path, ordinary]


def ids_of(path: str) -> Callable[[str], bytes]:
    """text -> its token ids by the tokenizers library, as little-endian 32-bit integers; special tokens' strings are ordinary text."""
    return lambda text: encoder_of(path, True).encode([text.encode()])[0].tobytes()


_WROTE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n_tokens", T.LongType())])
_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size together."""
    first = held = 0
    for k, n in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
        held += n
        if held >= AT_ONCE:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _writer(tokenizer: str, folder: str, end_id: int, shard_tokens: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part = TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        docs: list[int | None] = []
        held = before = files = 0

        def flush() -> None:
            nonlocal held, before, files
            known = np.array([d is not None for d in docs])
            data = build(np.concatenate(ids), np.array([d or 0 for d in docs], np.int64), known, np.concatenate(lengths), before, width)
            put_file(f"{folder}/part-{part:06d}-{files:06d}.wm", data)
            before, held, files = before + held, 0, files + 1
            ids.clear()
            lengths.clear()
            docs.clear()

        for b in batches:
            names = b.column(0).to_pylist()
            for a, e in _slices(b.column(1)):
                own, counts = encoder.encode(b.column(1).slice(a, e - a).cast(pa.binary()).to_pylist())
                if len(own) and int(own.max()) >> width:
                    raise ValueError(f"token id {int(own.max())} needs more than {width} bits")
                ended = np.full(len(own) + len(counts), end_id, np.uint32)
                mine = np.ones(len(ended), bool)
                mine[np.cumsum(counts + 1) - 1] = False
                ended[mine] = own
                ids.append(ended)
                lengths.append(counts + 1)
                docs += names[a:e]
                held += len(ended)
                if held >= shard_tokens:
                    flush()
        if docs:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64())], names=_WROTE.names)

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, shard_tokens: int = 1 << 22, width: int = 16) -> dict[int, int]:
    """Writes the files; the tokens before each partition (one number a partition, held by the driver)."""
    rows = need(docs, doc_id=T.LongType(), text=T.StringType()).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    wrote = {r["part"]: r["n_tokens"] for r in rows.mapInArrow(_writer(tokenizer, folder, end_id, shard_tokens, width), _WROTE).collect()}
    starts, total = {}, 0
    for part in sorted(wrote):
        starts[part] = total
        total += wrote[part]
    return starts


def _reader(starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = WaveletMatrix(content.as_py())
                ids = w.tokens().astype("<u4")
                ends = np.cumsum(w.lengths)
                begin = ends - w.lengths
                part = int(path.rpartition("/part-")[2].split("-")[0])
                sums = [zlib.crc32(ids[a:e]) for a, e in zip(begin, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(w.doc_ids, mask=~w.known), pa.array(begin + w.before + starts[part]), pa.array(w.lengths), pa.array(sums, pa.int64())], names=_READ.names)

    return run


def read(spark: SparkSession, folder: str, starts: dict[int, int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, from the files."""
    if not any(starts.values()) and not list_files(spark, folder):
        return spark.createDataFrame([], _READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    return files.select("path", "content").mapInArrow(_reader(starts), _READ)


def list_files(spark: SparkSession, folder: str) -> bool:
    """Whether the folder is there; it is made by its first file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs as wavelet matrices in the shared folder and reads the files back."""
    folder = scratch(docs.sparkSession, "wavelet")
    return read(docs.sparkSession, folder, write(docs, tokenizer, folder, **options))
