import random
import struct
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.packing import Search, Words, best_fit, bins_needed, pack, pack_sequences

from .common import awkward, empty

P = pytest.importorskip("public_tokenizers")
FILE = P.path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=70))
def test_pack_keeps_all_and_is_no_worse(sizes):
    bins = pack(sizes, 60)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 60 for b in bins)
    assert bins_needed(sum(sizes), 60) <= len(bins) <= len(best_fit(sizes, 60))


def test_search_empties_a_bin():
    # Best fit needs four bins for what three hold.
    sizes = [6, 5, 5, 4, 4, 3, 3]
    assert sum(sizes) == 30 and len(pack(sizes, 10)) == 3


def fewest(sizes, room):
    """The least number of bins, by trying every place for every piece."""
    best = [len(sizes)]

    def place(i, fills):
        if len(fills) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + sizes[i] <= room and fills[k] not in fills[:k]:
                place(i + 1, fills[:k] + [fills[k] + sizes[i]] + fills[k + 1 :])
        place(i + 1, [*fills, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_pack_against_all_packings():
    r, hit = random.Random(4), 0
    for _ in range(300):
        sizes = [r.randint(1, r.choice([12, 20])) for _ in range(r.randint(1, 11))]
        found, least = len(pack(sizes, 20)), fewest(sizes, 20)
        assert least <= found <= least + 1
        hit += found == least
    assert hit >= 297


@pytest.mark.parametrize("low,high", [(600, 800), (700, 700), (500, 500), (683, 683), (200, 900), (1, 2048), (1, 60)])
def test_ties_are_packed_fast(low, high):
    r = random.Random(2)
    sizes = [r.randint(low, high) for _ in range(4096)]
    began = time.perf_counter()
    bins = pack(sizes, 2048)
    assert time.perf_counter() - began < 3 and sorted(i for b in bins for i in b) == list(range(4096))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in bins) and len(bins) <= len(best_fit(sizes, 2048))


def test_search_ends_where_nothing_is_left_to_do():
    r = random.Random(7)
    for _ in range(60):
        sizes = [r.randint(1, 30) for _ in range(60)]
        s = Search(sizes, best_fit(sizes, 41), 41)
        bins = s.run()
        if len(bins) > bins_needed(sum(sizes), 41):
            fill = [sum(sizes[i] for i in b) for b in bins]
            for a, b in ((a, b) for a in range(len(bins)) for b in range(len(bins)) if a != b and 41 not in (fill[a], fill[b])):
                for i in bins[a]:
                    for out in [0, *(sizes[j] for j in bins[b])]:
                        d = sizes[i] - out
                        assert not (0 < d <= 41 - fill[b] and fill[a] < fill[b] + d)


def test_long_text():
    w = Words(FILE)
    text = " ".join(f"Word{i % 977} und\tÜber. don't" for i in range(60_000))
    assert len(text) > 1_000_000 and w.all_ids([text])[0] == w.whole(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Able", "able.", "..", ",", "Ünd", "İx", "Σ", "é", "'s", "don't", "12", "<|endoftext|>", " ", "\n", "\x1c", "\x85", "日本", "ﬁ", "ß", "_", "K"]), max_size=10).map("".join))
def test_words_like_the_library(text):
    w = test_words_like_the_library.__dict__.setdefault("w", Words(FILE))
    assert w.all_ids([text])[0] == w.whole(text) == w.ids(text)


def test_pack_sequences(spark):
    docs, rows = awkward(spark)
    got = pack_sequences(docs, FILE, length=64, group=16).collect()
    whole = Words(FILE).whole
    want = []
    for i, t in rows:
        ids = whole(t or "") + struct.pack("<I", 0)
        want += [(i, p, s // 4, len(ids[s : s + 256]) // 4, zlib.crc32(ids[s : s + 256])) for p, s in enumerate(range(0, len(ids), 256))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_sequences(empty(spark), FILE).count() == 0
