"""Text columns: normal form, hashes, fingerprints, uniform numbers from hashes, names and globs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: N-gram length and sampling modulus of fingerprints.
GRAM, MODULUS = 12, 4
#: Names of splits that mean another.
SPLIT_NAMES = {"dev": "validation", "val": "validation", "valid": "validation", "eval": "validation"}


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def norm_text(text: Column) -> Column:
    """NFKC, white space as one space, trimmed, lower case. Only texts beyond ASCII leave the JVM: for others a null does."""
    plain = F.coalesce(_nfkc(F.when(F.length(text) != F.octet_length(text), text)), text)
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " ")))


def norm_text_simple(text: Column) -> Column:
    """The normal form of text that NFKC leaves as it is; JVM only."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")))


def text_hash(*parts: Column, normal=norm_text) -> Column:
    """The hash of parts as one text: separators are white space in the normal form, so only the words count."""
    return F.sha2(normal(F.concat_ws(" ", *parts)), 256)


def uniform(key: Column, seed: int | str) -> Column:
    """A number in [0, 1) from 52 bits of the hash of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def grams(words: Column, n: int) -> Column:
    """All n-grams; words must be a column of its own, not an expression, as each gram slices it."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def fingerprints(words: Column, n: int = GRAM, modulus: int = MODULUS) -> Column:
    """Distinct crc32 values, divisible by modulus, of the n-grams of 2 n words or more."""
    hashed = F.filter(F.transform(grams(words, n), lambda g: F.crc32(g.cast("binary"))), lambda h: h % modulus == 0)
    return F.when(F.size(words) >= 2 * n, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


def hex_fingerprints(words: Column, n: int = GRAM) -> Column:
    """The same share of grams by md5, for engines without crc32: those whose first hex digit is divisible by 4."""
    hashed = F.filter(F.transform(grams(words, n), F.md5), lambda h: F.substring(h, 1, 1).isin("0", "4", "8", "c"))
    return F.when(F.size(words) >= 2 * n, F.array_distinct(hashed)).otherwise(F.array().cast("array<string>"))


def _spans(norm: str | None, n: int) -> tuple[memoryview, list[int], list[int]]:
    """The bytes of a normal form, and where each n-gram of a text of 2 n words or more starts and ends: words stand one space apart, so a gram is a span."""
    raw = (norm or "").encode("utf-8", "surrogatepass")
    at = [-1]
    while (k := raw.find(b" ", at[-1] + 1)) >= 0:
        at.append(k)
    at.append(len(raw))
    words = len(at) - 1
    return (memoryview(raw), [k + 1 for k in at[: words - n + 1]], at[n:]) if words >= 2 * n else (memoryview(raw), [], [])


def _plain(text: str | None) -> str:
    """The normal form in Python: str.split() parts at the characters that (?U)[\\s\\x1c-\\x1f] matches."""
    text = text or ""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split()).lower()


def _crc(raw: memoryview, starts: list[int], ends: list[int], modulus: int) -> list[int]:
    return list(dict.fromkeys(h for a, e in zip(starts, ends, strict=True) if (h := zlib.crc32(raw[a:e])) % modulus == 0))


def _hex(raw: memoryview, starts: list[int], ends: list[int], modulus: int) -> list[str]:
    """Those whose first hex digit is divisible by the modulus, 4 (or 1, 2, 8)."""
    found = dict.fromkeys(h for a, e in zip(starts, ends, strict=True) if (h := hashlib.md5(raw[a:e]).digest())[0] // 16 % modulus == 0)
    return [h.hex() for h in found]


def prepared(text: Column, hex_prints: bool = False, n: int = GRAM, modulus: int = MODULUS) -> Column:
    """(h, size, fps) of a text in one pass over Arrow batches: the hash and the length of its normal form, and ``fingerprints`` (or ``hex_fingerprints``) of that form's words. A null text is empty."""
    prints, kind = (_hex, StringType()) if hex_prints else (_crc, LongType())

    @F.pandas_udf(StructType([StructField("h", StringType()), StructField("size", LongType()), StructField("fps", ArrayType(kind))]))
    def of(x: pd.Series) -> pd.DataFrame:
        norms = [_plain(t) for t in x]
        return pd.DataFrame({"h": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in norms], "size": [len(t) for t in norms], "fps": [prints(*_spans(t, n), modulus) for t in norms]})

    return of(text)


def norm_split(split: Column) -> Column:
    low = F.lower(split)
    out = low
    for name, means in SPLIT_NAMES.items():
        out = F.when(low == name, means).otherwise(out)
    return out


def glob_regex(globs: list[str]) -> str:
    """One regular expression for any of several shell patterns; * crosses slashes, [..] is a set."""
    def one(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            c = glob[i]
            end = glob.find("]", i + 2) if c == "[" else -1
            if end > 0:
                body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
                i = end
            else:
                out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
            i += 1
        return out

    return "(?s)^(?:" + "|".join(map(one, globs)) + ")$" if globs else "(?!)"


def name_norm(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def task_token(source: Column) -> Column:
    """The normal name of what follows the first slash, or of all."""
    return name_norm(F.when(source.contains("/"), F.regexp_replace(source, r"(?s)^[^/]*/", "")).otherwise(source))


def squash(name: Column) -> Column:
    """The alphanumeric parts of a name after its first path component, three characters or longer."""
    parts = F.transform(F.split(F.lower(name), "/"), lambda p: F.regexp_replace(p, "[^a-z0-9]+", ""))
    return F.filter(F.slice(parts, 2, 1 << 20), lambda p: F.length(p) >= 3)


@F.pandas_udf(StringType())
def dominant_script(text: pd.Series) -> pd.Series:
    """The first word of the Unicode names of most letters among the first 400 characters; ties to the first seen."""
    def one(s: str | None) -> str:
        seen: dict[str, int] = {}
        for c in (s or "")[:400]:
            if c.isalpha():
                script = unicodedata.name(c, "OTHER").split(" ")[0]
                seen[script] = seen.get(script, 0) + 1
        return max(seen, key=seen.__getitem__) if seen else "NONE"

    return text.map(one)


def humanise(intent: Column) -> Column:
    """a_b_c as "a: b c"."""
    rest = F.replace(F.regexp_replace(intent, "^[^_]*_", ""), F.lit("_"), F.lit(" "))
    return F.when(intent.contains("_"), F.concat(F.substring_index(intent, "_", 1), F.lit(": "), rest)).otherwise(intent)
