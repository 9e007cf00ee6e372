"""op1's ids where texts hold strings of the vocabulary's added tokens, against the library's default encode."""

import zlib

import numpy as np

from quillon.llm import wavelet
from quillon.llm.queries import vocabulary_file

TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n", "<|endoftext|>c", "d <|endoftext| > e", "", None, "plain  text ", "  <|endoftext|>\n\n f's 12"]


def test_added_tokens_are_ids_of_their_own(spark):
    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    expected, start = [], 0
    for i, t in enumerate(TEXTS):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert own.encode(TEXTS[0], add_special_tokens=False).ids == [87, 220, 50256, 331]
    got = wavelet.round_trip(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected


def test_encoder_is_the_librarys_own_encode(monkeypatch):
    """Whole texts, with few remembered parts, against the library; long texts, white space of all kinds, broken UTF-8."""
    import random

    from tokenizers import Tokenizer

    path = vocabulary_file("byte_bpe_50k.json")
    own, rng = Tokenizer.from_file(path), random.Random(9)
    bits = [" ", "  ", "\n", "\t", " \n ", "\x85", "\xa0", "\u2028", "\u3000", "\x1c", "\x7f", "a", "B", "1", "23", "é", "日本", "🎉", "'s", "'ll", ".", ",", "!?", "word", "Other", "<|endoftext|>", "<|endoftext", "_", "-"]
    texts = ["".join(rng.choice(bits[:-4] if rng.random() < 0.9 else bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [" ".join(rng.choice(bits) for _ in range(200_000)), None, "", " ", " x"]
    monkeypatch.setattr(wavelet, "MOST", 500)
    encoder = wavelet.Encoder(path)
    for _ in range(2):
        ids, counts = encoder.encode([None if t is None else t.encode() for t in texts])
        want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert encoder.encode([b"a \xff b"])[0].tolist() == own.encode("a \ufffd b", add_special_tokens=False).ids


def test_ids_that_do_not_fit_are_refused(spark):
    import pytest

    with pytest.raises(Exception, match="needs more than 9 bits"):
        wavelet.round_trip(spark.createDataFrame([(1, "several words of text")], "doc_id long, text string"), vocabulary_file("byte_bpe_50k.json"), width=9).collect()
