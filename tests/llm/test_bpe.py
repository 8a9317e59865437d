import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tessera.llm.bpe as bpe
from tessera.llm.bpe import coder, decode_ids, encode_texts, round_trip_digest

from .common import awkward, empty

P = pytest.importorskip("public_tokenizers")
FILE = P.path("byte_bpe_50k.json")
_kept = []


def library():
    from tokenizers import Tokenizer

    if not _kept:
        _kept.append(Tokenizer.from_file(FILE))
    return _kept[0]


def want(texts):
    return [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def got(texts):
    ids, off = coder(FILE).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


PARTS = ["a", "the", " ", "  ", "\n", "é", "'s", "'ll", "'S", "’", "x ", " \n", "\r", "\t", "12", "½", "<|endoftext|>", "<|endof", "text|>", "日本", "\x00", ";\r\n", "word", "\x1c", "\x85", "​", "\U0001f600", "՘", "Ɤ", "ⅷ"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=12)), max_size=4))
def test_like_the_library(texts):
    assert got(texts) == want(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", "ing", "aa", "=", "-", "é"]), min_size=1, max_size=60).map("".join), st.integers(1, 40))
def test_rank_by_rank_is_the_same(word, times):
    before = bpe.LONG
    try:
        bpe.LONG = 3
        assert got([word * times]) == want([word * times])
    finally:
        bpe.LONG = before


def test_long_words():
    import random

    r = random.Random(1)
    texts = ["a" * 20_001, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)), "ACGT" * 9_000, "".join(r.choices("acgt", k=30_000)), "日本語の文章" * 3_000, "=" * 5_003, " " * 7_001 + "x"]
    assert got(texts) == want(texts)


def test_text_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    texts = ["one two  three, four 'five's six7 8 <|endoftext|> nine\n ten  ", "abcdefghijklmno pqrstuvwxyz x é y"]
    assert got(texts) == want(texts)


def test_all_letters_and_numbers_the_library_knows():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3100 or c % 7 == 0 or bpe.doubtful().match(chr(c)))]
    texts = ["".join(f"a{c}1{c}! {c}" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    assert got(texts) == want(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50256), max_size=20), max_size=3))
def test_decode_like_the_library(rows):
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    flat = np.array([i for r in rows for i in r], np.int64)
    assert [x.decode() for x in coder(FILE).decode(flat, off)] == [library().decode(r, skip_special_tokens=False) for r in rows]


def test_table(spark):
    docs, rows = awkward(spark)
    docs = docs.withColumnsRenamed({"k": "ids", "found": "decoded"})
    ids = want([t or "" for _, t in rows])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expect = [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for (i, t), x in zip(rows, ids)]
    out = round_trip_digest(docs, FILE)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.schema["n_tokens"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expect, key=str)
    assert round_trip_digest(empty(spark), FILE).count() == 0


def test_arrays(spark):
    docs, rows = awkward(spark)
    made = encode_texts(docs, FILE, ["doc_id", "text", "d"])
    back = decode_ids(made, FILE, ["doc_id", "text"], out="again").collect()
    assert len(back) == len(rows) and all(r.again == (r.text or "") for r in back)
    odd = spark.createDataFrame([(1, [None, 50256, 99999, -3]), (2, None), (3, [])], "i int, ids array<int>")
    assert {r.i: r.decoded for r in decode_ids(odd, FILE, ["i"]).collect()} == {1: "<|endoftext|>", 2: "", 3: ""}
    with pytest.raises(ValueError):
        encode_texts(docs, FILE, ["text"], out="text")


def test_refused_files(tmp_path):
    with open(FILE, encoding="utf-8") as f:
        told = json.load(f)
    told["model"]["merges"] = told["model"]["merges"][::-1]
    path = tmp_path / "x.json"
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError, match="before its parts"):
        coder(str(path))
    told["normalizer"] = {"type": "NFC"}
    path = tmp_path / "y.json"
    path.write_text(json.dumps(told))
    with pytest.raises(ValueError):
        coder(str(path))
