import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.token_counts import Counter, count_tokens

from .common import awkward, empty

P = pytest.importorskip("public_tokenizers")
FILE = P.path("piece_bpe_32k.model")
_kept = []


def counter():
    if not _kept:
        _kept.append(Counter(FILE))
    return _kept[0]


def test_proof():
    c = counter()
    assert c.parts and c.lines and len(c.proved) > 10_000
    assert all(len(c.model.encode(w)) == 1 for w in list(c.proved)[:500] if w)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "é", "▁", "x ", " \n", "\r", "\t", "1", "<s>", "</s>", "日", "\x00", ";\r\n", "word"]), max_size=12).map("".join))
def test_like_the_library(text):
    assert counter().count(text) == len(counter().model.encode(text))


def test_table(spark):
    docs, rows = awkward(spark)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, FILE, limit=100).collect()), key=str)
    sp = counter().model
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(empty(spark), FILE).count() == 0
