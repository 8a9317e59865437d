import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as X
from tessera.llm.components import components

from .common import awkward, empty


def fingerprint_brute(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(fps, threshold=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_every_close_pair_meets_at_a_home():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    homes, places = [set() for _ in a], [set() for _ in a]
    for r, k, h in zip(*X.anchors(a)):
        homes[r].update([k] if h else [])
    for r, k, _ in zip(*X.anchors(b)):
        places[r].add(k)
    assert all(x & y for x, y in zip(homes, places))


@pytest.mark.parametrize("many", [2048, 8])
def test_links(spark, monkeypatch, many):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = []
    for _ in range(400):
        x = centres[rng.integers(0, 6)]
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= np.uint64(1) << np.uint64(bit)
        fps.append(int(x))
    fps = sorted(set(fps))
    monkeypatch.setattr(X, "MANY", many)
    near = X.links_at(np.array(fps, np.uint64), 3)
    assert all(bin(a ^ b).count("1") <= 3 for a, b in near) and len(near) < len(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    root = {r.node: r.root for r in components(X.links(df)).collect()}
    label = groups(fps)
    mine = {}
    for x, g in zip(fps, label):
        mine.setdefault(g, set()).add(int(np.uint64(x).view(np.int64)))
    want = {min(v): v for v in mine.values() if len(v) > 1}
    got = {}
    for n, r in root.items():
        got.setdefault(r, set()).add(n)
    assert got == want


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(5, 5), (3, 2)], "u long, v long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert root == {i: 0 if i <= 30 else 31 for i in range(61)}


def test_table(spark):
    docs, rows = awkward(spark)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in X.simhash_digest(docs).collect()), key=str)
    fps = [fingerprint_brute(t) for _, t in rows]
    label, least = groups(fps), {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    assert got == sorted([(i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, label)], key=str)
    assert X.simhash_digest(empty(spark)).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def prose(seed, n=300):
    r = random.Random(seed)
    return ["".join(r.choices(["th", "er", "on", "an", "re", "ed", "ti", "es", "ou", "in"], k=r.randint(1, 4))) for _ in range(n)]


def test_one_of_each_group_stays(spark):
    docs, rows = awkward(spark)
    near = [" ".join(prose(s)) for s in range(5)]
    more = [(400 + i, t) for i, t in enumerate(near)] + [(500 + i, t.replace(" ", " \n", 3).replace(t.split()[150], "other", 1)) for i, t in enumerate(near)]
    rows += more
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = X.drop_near_duplicates(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = [(r.doc_id, r.text) for r in got.collect()]
    plain = [" ".join((t or "").lower().split()) for _, t in kept]
    assert len(set(plain)) == len(kept)
    assert {400, 401, 402, 403, 404} <= {i for i, _ in kept} and not {500, 501, 502, 503, 504, 1005, 1006} & {i for i, _ in kept}
    left = list(rows)
    for r in kept:
        left.remove(r)
    for i, t in left:
        others = [x for _, x in rows]
        others.remove(t)
        assert max(jaccard(t, x) for x in others) >= 0.8
    assert X.drop_near_duplicates(empty(spark)).count() == 0


def remaining(texts):
    """Places that stay by brute force: the first of each component of texts at a Jaccard of 0.8 or more."""
    label = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return set(label)


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in X.drop_near_duplicates(docs).collect()}


def test_truncated_and_appended_copies_go(spark, monkeypatch):
    monkeypatch.setattr(X, "COMMON", 3, raising=False)
    texts = []
    for seed, (n, cut) in enumerate((n, cut) for n in (12, 40, 90, 150, 300, 440, 470, 560, 900, 1500, 3000) for cut in (-0.19, -0.1, 0.12, 0.24, 0.4)):
        w = [f"{x}{seed}" for x in prose(seed, n)]
        new = [f"{x}new" for x in prose(1000 + seed, n)]
        texts += [" ".join(w), " ".join(w[: int(n * (1 + cut))] if cut < 0 else w + new[: int(n * cut)])]
    texts = random.Random(1).sample(texts, len(texts))
    want = remaining(texts)
    assert len(texts) * 0.5 < len(want) < len(texts) * 0.75 and kept(spark, texts) == want


@pytest.mark.parametrize("pattern", ["order {} has shipped", "order {} has been shipped", "your order {} has been shipped today"])
def test_short_texts_of_one_pattern_stay(spark, pattern):
    texts = [pattern.format(i) for i in range(600)] + [pattern.format(7).title()]
    assert kept(spark, texts) == set(range(600))


def test_only_texts_of_the_similarity_go(spark):
    texts = []
    for seed in range(120):
        n = (60, 200, 500, 900)[seed % 4]
        w = [f"{x}{seed}" for x in prose(seed, n)]
        shared = int(n * (0.8, 0.84, 0.87, 0.9)[seed // 4 % 4])  # Jaccard of about 0.67, 0.72, 0.77, 0.82
        texts += [" ".join(w), " ".join(w[:shared] + [f"other{seed}x{i}" for i in range(n - shared)])]
    want = remaining(texts)
    assert len(texts) * 0.75 < len(want) < len(texts) and kept(spark, texts) == want


@pytest.mark.parametrize(("few", "together"), [(16, X.TOGETHER), (2, 900)])
def test_groups_at_the_edge_of_the_similarity(spark, monkeypatch, few, together):
    """Many texts of one origin, some pairs above and some below 0.8, so candidates that fail must not part what links,
    also where a group is dealt into shares."""
    monkeypatch.setattr(X, "FEW", few)
    monkeypatch.setattr(X, "TOGETHER", together)
    monkeypatch.setattr(X, "PIVOTS", 2)
    r, texts = random.Random(16), []
    for origin in range(6):
        w = [f"{x}{origin}" for x in prose(origin, 250)]
        for i in range(40):
            v = list(w)
            for p in r.sample(range(250), r.randint(1, 7)):
                v[p] = f"e{i}x{p}"
            texts.append(" ".join(v[: r.randint(215, 250)]))
    sets = [shingles(t) for t in texts]
    near = [[9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets[:40]] for a in sets[:40]]
    assert 0.05 < np.mean(near) < 0.9
    want = remaining(texts)
    assert 6 < len(want) < 200 and kept(spark, texts) == want


def test_texts_meet_by_some_shingle_of_the_front():
    """The rule of who meets loses no pair: over sets of any sizes at and above 0.8."""
    r = np.random.default_rng(4)
    for _ in range(3000):
        a = int(r.integers(1, 60))
        common = int(r.integers(0, a + 1))
        b = common + int(r.integers(0, 30))
        if not b or 9 * common < 4 * (a + b):
            continue
        order = r.permutation(a + b - common)
        x, y = np.sort(order[:a]), np.sort(np.concatenate([order[:common], order[a:]]))
        shared = np.intersect1d(x, y)
        i, j = np.searchsorted(x, shared), np.searchsorted(y, shared)
        meets = [X.may_meet(np.array([a, b]), np.array([p, q]), 0, 1) for p, q in zip(i.tolist(), j.tolist())]
        assert any(meets)


@pytest.mark.parametrize("many", [2048, 20])
def test_a_hot_shingle_of_texts_that_are_not_alike(spark, monkeypatch, many):
    """Messages of one pattern, of several lengths, so all prefixes hold a shingle of the pattern; and a large bucket of texts
    of which some are alike, compared block by block."""
    monkeypatch.setattr(X, "MANY", many)
    monkeypatch.setattr(X, "BLOCK", 3)
    r = random.Random(7)
    words = [f"{x}{i}" for i, x in enumerate(prose(3, 60))]
    texts = [f"your order has been shipped and will arrive at the door a{i:03d}x" for i in range(400)]
    texts += [f"your order has been shipped and will arrive at the door b{i}x c{i}y" for i in range(100)]
    for i in range(300):  # a common middle, a ninth or more of each text its own
        v = words[: r.choice([40, 45, 50])]
        for p in r.sample(range(len(v)), r.choice([0, 1, 1, 2])):
            v[p] = f"z{i}y{p}"
        texts.append(" ".join(v))
    r.shuffle(texts)
    assert kept(spark, texts) == remaining(texts)


def test_near_duplicates_meet_by_fingerprints(spark, monkeypatch):
    """The pipeline's stage finds what fingerprints link through the covering code, also without the other candidates."""
    none = lambda rows: rows.sparkSession.createDataFrame([], "u long, v long")
    monkeypatch.setattr(X, "bucket_pairs", none)
    words = [f"w{i * 7919 % 10007}" for i in range(1500)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), None, " ", "w1 w2", "w1 w3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in X.drop_near_duplicates(docs).collect()) == [0, 2, 3, 5, 6]
