import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality as X
from tessera.llm.common import text_bytes

from .common import awkward, empty

SF = "/root/testdata/sf0.01"


def plain(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(["th", "er", "on", "an", "re", "ed", "ti", "es"], k=r.randint(1, 4))) + r.choice(["", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def net():
    good = [plain(i, 20 + 9 * i) for i in range(60)]
    bad = ["buy*** now!!! " * (3 + i % 9) for i in range(30)] + ["same same same same " * (2 + i % 9) for i in range(30)]
    return X.train(good + bad, [1] * 60 + [0] * 60)


def score(net, texts):
    return net.scores(*text_bytes(pa.array(texts, pa.string())), net.tables() if net.weight is not None else [])


def forward(net, text):
    """The whole network by hand: every position, chunk by chunk."""
    raw = text.encode()
    codes = np.concatenate([X.CODES[np.frombuffer(raw, np.uint8)], np.zeros((X.WIDTH, X.CODES.shape[1]))]).astype(float)
    r = np.array([np.maximum(np.concatenate(codes[t : t + X.WIDTH]) @ net.filters + net.bias, 0) for t in range(len(raw))]).reshape(-1, X.FILTERS)
    cells = max(1, -(-len(raw) // X.CELL))
    hidden = []
    for c in range(max(1, cells - 1)):
        part = r[c * X.CELL : (c + 2) * X.CELL]
        both = np.concatenate([part.sum(0) / (X.FEW + len(part)), part.max(0, initial=0)])
        hidden.append(np.tanh(both @ net.hidden + net.hidden_bias))
    return 1 / (1 + np.exp(-(np.max(hidden, 0) @ net.weight + net.weight_bias)))


def test_network_by_hand(net):
    texts = ["A text of more than one cell, é, " * 9, "", "x", "y" * 128, "z" * 129, plain(7, 90), "buy*** now!!! " * 40, plain(8, 20) + " same same same" * 40]
    assert np.allclose(score(net, texts), [forward(net, t) for t in texts], atol=1e-5)


def test_long_text(net):
    text = plain(3, 200) * 2000
    got = score(net, [text, plain(3, 200)])
    assert len(text) > 1_500_000 and abs(got[0] - got[1]) < 0.2


def test_scores_stand_alone_and_cover_the_end(net):
    texts = [plain(99, 400), plain(99, 400) + " buy*** now!!!" * 20, "", "x", "buy*** now!!! " * 30]
    together = score(net, texts)
    assert np.allclose(together, [score(net, [t])[0] for t in texts], atol=1e-12)
    assert together[0] > 0.5 > together[4] and together[0] - together[1] > 1e-4


def test_without_classes():
    assert score(X.train([], []), ["a"])[0] == 0.5
    assert score(X.train(["a"] * 8, [1] * 8), ["a", None]).tolist() == [0.9, 0.9]


def test_table(spark):
    docs, rows = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = X.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert X.classify(empty(spark), labels).count() == 0
    assert {r.score for r in X.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_training_never_sees_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    texts, ys = X.training_sample(docs, labels)
    used = {int(t.split()[1]) for t in texts}
    assert used == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5} and len(ys) == len(texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = X.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97
    assert np.mean([s >= 0.3 for s in good]) >= 0.97
