"""The words of many texts and their hashes, by numpy over the texts' bytes; no Python object is made for a word."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a word that is longer is hashed whole.
CHUNK = 1 << 17
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[tuple[int, int], np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Two 64-bit numbers for each byte.
_BYTES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in BASES]


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    n = max(n, CHUNK + 1)
    key = (base, n)
    if key not in _powers:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        if n > CHUNK + 1:
            return out
        _powers[key] = out
    return _powers[key]


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of each run [start, end) of bytes; runs ascend and don't overlap. which: the family, 0 or 1."""
    base, table = BASES[which], _BYTES[which]
    back = pow(base, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    sums, each = np.zeros(CHUNK + 1, np.uint64), np.empty(CHUNK, np.uint64)
    first = 0
    while first < len(starts):
        origin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, origin + CHUNK, side="right")))
        a, e = starts[first:last] - origin, ends[first:last] - origin
        n = int(e[-1])
        if n > len(each):
            sums, each = np.zeros(n + 1, np.uint64), np.empty(n, np.uint64)
        np.multiply(table[data[origin : origin + n].astype(np.intp)], powers(base, n)[:n], out=each[:n])
        np.cumsum(each[:n], out=sums[1 : n + 1])
        out[first:last] = (sums[e] - sums[a]) * powers(back, n)[a] + (e - a).astype(np.uint64)
        first = last
    return mixed(out)


def rolled(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of each k consecutive entries, by prefix sums modulo 2^64."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    out, back = np.empty(n - k + 1, np.uint64), pow(base, -1, 1 << 64)
    for a in range(0, n - k + 1, CHUNK - k):
        part = h[a : a + CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part))[: len(part)], out=sums[1:])
        some = (sums[k:] - sums[:-k]) * powers(back, len(part))[: len(part) - k + 1]
        out[a : a + len(some)] = some
    return mixed(out)


class Words:
    """The words of texts (bytes or None): bounds in the joined bytes, and for each text its first word and the one after its last."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        """lower: with A-Z, and nothing else, in lower case."""
        raw = b"\n".join([t or b"" for t in texts]) + b"\n"
        self.data = np.frombuffer(raw, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        word = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        edge = np.concatenate([[0], edge]) if word[0] else edge
        self.starts, self.ends = edge[::2].copy(), edge[1::2].copy()
        stop = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
        self.last = np.searchsorted(self.starts, stop)
        self.first = np.concatenate([[0], self.last[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.sizes = self.last - self.first

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return runs(self.data, self.starts, self.ends, which)

    def text(self, i: int, keep: np.ndarray) -> bytes:
        """The words of text i that a mask over all words keeps, joined by one space."""
        at = np.flatnonzero(keep[self.first[i] : self.last[i]]) + self.first[i]
        if not len(at):
            return b""
        lo, hi = int(self.starts[at[0]]), int(self.ends[at[-1]])
        held = np.zeros(hi - lo + 2, np.int8)
        held[self.starts[at] - lo] += 1
        held[self.ends[at] - lo + 1] -= 1  # with the byte after the word
        part = np.append(self.data[lo:hi], np.uint8(32))
        part[(part >= 9) & (part <= 13)] = 32
        return part[np.cumsum(held[:-1], dtype=np.int8) > 0].tobytes()[:-1]
