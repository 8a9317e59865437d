import hashlib
import zlib

import numpy as np
import pytest

from tessera.llm import media as X

from .common import awkward, empty


@pytest.mark.parametrize("channels", [1, 3])
def test_all_filters(channels):
    rng = np.random.default_rng(0)
    for _ in range(25):
        h, w = rng.integers(1, 9, 2)
        kinds, img = rng.integers(0, 5, h), rng.integers(0, 256, (h, w * channels)).astype(np.uint8)
        out = np.zeros_like(img)
        for y in range(h):
            for x in range(w * channels):
                a, b = int(img[y, x - channels]) if x >= channels else 0, int(img[y - 1, x]) if y else 0
                c = int(img[y - 1, x - channels]) if y and x >= channels else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                out[y, x] = (int(img[y, x]) - [0, a, b, (a + b) // 2, near][kinds[y]]) & 255
        assert (X.unfilter(kinds, out, channels) == img).all()


def test_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for shape in [(1, 1), (5, 7), (4, 64, 3), (1, 3, 3)]:
        px = rng.integers(0, 256, shape).astype(np.uint8)
        data = X.encode(px)
        assert (X.decode(data) == px).all()
        for i in range(0, len(data), 3):
            with pytest.raises(X.BadImage):
                X.decode(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
        with pytest.raises(X.BadImage):
            X.decode(data[:-5])


def test_hash_follows_the_picture():
    y, x = np.mgrid[0:64, 0:64]
    r = np.random.default_rng(2)
    a = 128 + sum(r.normal() * 9 * np.cos(np.pi * (u * (2 * x + 1) + v * (2 * y + 1)) / 128) for u in range(8) for v in range(8))
    a = np.clip(a, 0, 255).astype(np.uint8)
    noisy = np.clip(a.astype(int) + np.random.default_rng(0).integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    bits = lambda p, q: bin(int(X.dct_hash(p), 16) ^ int(X.dct_hash(q), 16)).count("1")
    assert bits(a, noisy) <= 6 < bits(a, np.ascontiguousarray(a.T[::-1] // 2))


def test_table(spark):
    docs, rows = awkward(spark)
    got = X.media_digest(docs).collect()
    assert len(got) == len(rows)
    plain = {}
    for i, t in rows:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        plain.setdefault(i, set()).add((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in plain[r.doc_id]
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert X.media_digest(empty(spark)).count() == 0


def test_damaged_rows(spark):
    df = spark.createDataFrame([(1, X.encode(np.zeros((2, 2), np.uint8))), (2, b"no image"), (3, None)], "i int, media binary")
    got = {r.i: r.error for r in X.read_features(df, ["i"]).collect()}
    assert got == {1: None, 2: "signature", 3: "null"}
