"""Operators 3 and 5 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import bytespans, classes, induced, substrings

from .common import awkward, empty


def words_brute(rows, window):
    held, out = {}, []
    parts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in parts:
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p : p + window])
                held[k] = min(held.get(k, i), i)
    for i, w in parts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and held[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_cover_is_a_difference_cover():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize(("seed", "window"), [(0, 50), (1, 50), (2, 40), (3, 60)])
def test_words(spark, seed, window):
    docs, rows = awkward(spark, 40, seed)
    got = substrings.remove_repeats(docs, window, with_text=True).collect()
    assert sorted([tuple(r) for r in got], key=str) == words_brute(rows, window)


def twins(n):
    """Two texts of n letters that differ at every place, in the order that polynomials modulo a power of two can't tell."""
    one = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[x ^ k] for x in one) for k in (0, 1)]


def test_words_that_polynomials_confuse(spark):
    a, b = twins(4096)
    rest = [f"w{i}" for i in range(60)]
    orders = [" ".join({"a": "one", "b": "two"}[c] for c in t) for t in (a, b)]
    rows = [(0, " ".join([a, *rest[:49]])), (1, " ".join([b, *rest[:49]])), (2, " ".join([a, *rest[:49]])), (3, orders[0]), (4, orders[1]), (5, "long " * 400_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    want = {r[0]: r[2] for r in words_brute(rows, 50)}
    assert got == want and (got[0], got[1], got[2]) == (0, 0, 50)


def test_words_empty(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="window"):
        substrings.repeated_windows(empty(spark), 20)


def test_settle_over_batches(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 3), 0, r.randint(0, 9)) for _ in range(200)]
    rows = [(k, k * 10 + r.randint(0, 2), d) for k, _, d in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(k, s, -s, d, False) for k, s, d in rows], classes.SCHEMA)
        got = {tuple(x) for x in classes.settle(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {}
    for k, s, d in rows:
        first[k, s] = min(d, first.get((k, s), d))
    several = {k for k, _ in first if len([1 for x in first if x[0] == k]) > 1}
    want = {(d, s, -s, False) for k, s, d in rows if d > first[k, s]} | {(d, s, -s, True) for (k, s), d in first.items() if k in several}
    assert got == want


def suffixes_brute(t, depth):
    order = sorted(range(len(t)), key=lambda p: t[p : p + depth], reverse=True)
    pre = [t[p : p + depth] for p in order]
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return pre, [0] + [same(a, b) for a, b in zip(pre, pre[1:])]


def mapped(data, tmp_path):
    (tmp_path / "text").write_bytes(data)
    return np.memmap(tmp_path / "text", np.uint8, "r")


@pytest.mark.parametrize("in_file", [False, True])
@pytest.mark.parametrize(("block", "memory"), [(1 << 16, induced.IN_MEMORY), (5, 60), (5, 0), (7, 3000)])
def test_suffixes(monkeypatch, tmp_path, block, memory, in_file):
    monkeypatch.setattr(induced, "BLOCK", block)
    r = random.Random(3)
    for k in range(150):
        t = bytes(r.choices(b"abc"[: r.randint(1, 3)], k=r.randint(1, 90))) * r.randint(1, 2)
        if k % 5 == 0:
            t = bytes(r.choices(b"abcd", k=600)) + t * 2
        depth = r.randint(1, 40)
        found = list(induced.suffixes(mapped(t, tmp_path) if in_file else np.frombuffer(t, np.uint8), depth, memory))
        at, shared = (np.concatenate([x[i] for x in found]).tolist() for i in (0, 1))
        assert sorted(at) == list(range(len(t)))
        pre, want = suffixes_brute(t, depth)
        assert [t[p : p + depth] for p in at] == pre and shared[1:] == want[1:]


def prose(size):
    r = random.Random(1)
    words = [bytes(r.choices(b"abcdefgh", k=r.randint(1, 9))) for _ in range(3000)]
    t = b" ".join(r.choices(words, k=size // 5))[:size]
    return t[: -size // 40] + t[size // 8 : size // 8 + size // 40]


def test_recursion_goes_deep(monkeypatch, tmp_path):
    """4 MB of text in 1 MB of memory: the reduced text is sorted by recursion."""
    monkeypatch.setattr(induced, "BLOCK", 1 << 12)
    levels, plain = [], induced._induced
    monkeypatch.setattr(induced, "_induced", lambda text, *a: levels.append(len(text)) or plain(text, *a))
    t = prose(4 << 20)
    order, last = [], None
    for at, shared in induced.suffixes(mapped(t, tmp_path), 100, 1 << 20):
        for x, y, s in ((last, at[0], shared[0]), (at[len(at) // 2 - 1], at[len(at) // 2], shared[len(at) // 2])) if len(at) > 1 else ():
            if x is not None:
                a, b = t[x : x + 100], t[y : y + 100]
                assert a >= b and a[:s] == b[:s] and (s == 100 or a[s : s + 1] != b[s : s + 1])
        last = at[-1]
        order.append((np.array(at), np.array(shared)))
    at, shared = (np.concatenate(x) for x in zip(*order))
    assert len(levels) >= 2 and (np.sort(at) == np.arange(len(t))).all()
    # windows of 100 bytes that stand twice, by brute force
    seen, twice = set(), 0
    for p in range(len(t) - 99):
        k = hash(t[p : p + 100])
        twice += k in seen
        seen.add(k)
    assert int((shared >= 100).sum()) == twice


def test_recursion_stays_small(monkeypatch, tmp_path):
    import tracemalloc

    monkeypatch.setattr(induced, "BLOCK", 1 << 10)
    text = mapped(prose(1 << 19), tmp_path)
    tracemalloc.start()
    n = sum(len(at) for at, _ in induced.suffixes(text, 100, 1 << 17))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) and peak < 8 << 20


def bytes_brute(rows, window):
    seen, out = {}, []
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: (x[0], x[1] or "")):
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            k = b[p : p + window]
            seen[k] = min(seen.get(k, (i, p)), (i, p))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if i is not None and seen[b[p : p + window]] < (i, p):
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_parts_of_a_hot_stretch_hold_each_window_once():
    r = random.Random(2)
    for _ in range(50):
        piece = bytes(r.choices(b"abcd ", k=r.randint(100, 399)))
        seed = int(bytespans._grams(np.frombuffer(piece, np.uint8)).min().view(np.int64))
        parts = list(bytespans.parted_again(piece, seed, 100))
        assert [a + i for _, a, n in parts for i in range(n - 99)] == list(range(len(piece) - 99))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_bytes(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(bytespans, "HOT", 2)
        monkeypatch.setattr(bytespans, "SHARD", 2000)
    docs, rows = awkward(spark, 40, seed)
    rows = [x for x in rows if x[0] != 6]  # an id with two texts
    got = bytespans.remove_repeated_bytes(docs.where("doc_id is null or doc_id <> 6"), 100)
    assert sorted([tuple(r) for r in got.collect()], key=str) == bytes_brute(rows, 100)


def test_bytes_cut_in_segments(spark, monkeypatch):
    monkeypatch.setattr(bytespans, "SEGMENT", 500)
    raw = np.frombuffer(b"".join(b"%d," % i for i in range(4000)), np.uint8)
    parts = list(bytespans._segments(raw, np.array([0, len(raw)]), 100))
    starts = [a + p for _, part, off, a in parts for p in range(len(part) - 99)]
    assert len(parts) > 5 and starts == list(range(len(raw) - 99))


def test_bytes_edges(spark):
    assert bytespans.remove_repeated_bytes(empty(spark)).count() == 0
    df = spark.createDataFrame([(6, "ab" * 100), (6, "cd" * 100), (7, "ab" * 100)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in bytespans.remove_repeated_bytes(df).collect()}
    assert (7, 200) in got and all(n in (198, 200) for _, n in got)


def test_repeated_in(monkeypatch):
    r = random.Random(9)
    for _ in range(200):
        window = r.randint(1, 6)
        pieces = [bytes(r.choices(b"ab", k=r.randint(window, 20))) for _ in range(r.randint(1, 5))]
        seen, want = set(), []
        for p in pieces:
            marks = []
            for i in range(len(p) - window + 1):
                if p[i : i + window] in seen:
                    marks.append(i)
                seen.add(p[i : i + window])
            want.append(marks)
        assert [x.tolist() for x in bytespans.repeated_in(pieces, window)] == want
        monkeypatch.setattr(bytespans, "HELD", 10)
        assert [x.tolist() for x in bytespans.repeated_in(pieces, window, 100)] == want
        monkeypatch.undo()
