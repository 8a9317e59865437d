import random

import numpy as np

from tessera.llm import decontaminate as X

from .common import awkward, empty


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64) for _ in range(200)]
    b = [rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64) for _ in range(200)]
    assert X.align(a, b).tolist() == [smith_waterman(x, y) for x, y in zip(a, b)]


def words(text):
    return X._words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]


def test_pairs(spark, monkeypatch):
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=4)) for _ in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(15, 60)))) for i in range(12)]
    edited = items[1][1].split()
    for p in (4, 12):
        edited[p] = "edited"
    del edited[8]
    docs, rows = awkward(spark)
    more = [(200, "before " + items[0][1].upper() + ", after"), (201, "x " * 500 + " ".join(edited)), (202, " ".join(r.choices(vocabulary, k=400))), (203, items[2][1] + " " + items[3][1]), (200, "again"), (204, " ".join(items[4][1].split()[:6]))]
    rows = rows + more
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    table = spark.createDataFrame([*items, (90, None), (91, ""), (92, "one two"), (93, items[0][1]), (None, items[5][1])], "item_id long, text string")
    want = {}
    for d, t in rows:
        for i, x in [*items, (93, items[0][1])]:
            score = round(float(smith_waterman(words(x), words(t))) / len(words(x)), 6)
            if score >= X.LEAST:
                want[d, i] = max(score, want.get((d, i), 0))
    assert {(200, 0), (201, 1), (203, 2), (203, 3), (200, 93)} <= set(want)
    found = lambda: {(p.doc_id, p.item_id): p.score for p in X.contaminated_pairs(docs, table).collect()}
    assert found() == want
    monkeypatch.setattr(X, "ITEM_BYTES", 900)
    assert len(X._blocks(table, "item_id", "text")) > 2 and found() == want


def test_ids_of_any_kind(spark):
    docs = spark.createDataFrame([("a", "one two three four five"), (None, None)], "doc_id string, text string")
    for kind, x in (("string", "i"), ("int", 7)):
        got = X.contaminated_pairs(docs, spark.createDataFrame([(x, "one two three four")], f"item_id {kind}, text string")).collect()
        assert [tuple(r) for r in got] == [("a", x, 1.0)]


def test_every_alignment_that_scores_has_enough_pairs_and_a_seed():
    r = random.Random(3)
    for _ in range(300):
        vocabulary = [f"v{i}" for i in range(r.choice([3, 8, 40]))]
        item = r.choices(vocabulary, k=r.randint(3, 25))
        text = [x for x in (y if r.random() > 0.25 else r.choice([None, "new"]) for y in item) if x]
        text = r.choices(vocabulary, k=5) + text + r.choices(vocabulary, k=5)
        known = X.Items.of([1], [" ".join(item)])
        f = X.Finder(known, np.array([r.randint(0, 9) for _ in known.hashes]), X.LEAST)
        raw = np.frombuffer(" ".join(text).encode(), np.uint8)
        score = smith_waterman(words(" ".join(item)), words(" ".join(text))) / len(item)
        assert f.found(raw, np.array([0, len(raw)])) == ([(0, 0, round(float(score), 6))] if score >= X.LEAST else [])


def test_long_repetitive_text(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "w0 w1 w2 " * 4000 + item)], "doc_id long, text string")
    got = X.contaminated_pairs(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(p.doc_id, p.item_id, p.score) for p in got] == [(1, 1, 1.0)]


def test_empty(spark):
    docs, rows = awkward(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert X.contaminated_pairs(docs, none).count() == 0
    assert X.find_contaminated(docs, none).count() == len(rows)
    assert X.contaminated_pairs(empty(spark), spark.createDataFrame([(1, "a b c d e")], none.schema)).count() == 0


def test_edited_copies_down_to_the_least_score(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghij", k=4)) for _ in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 4, 7, 24, 41, 60])))) for i in range(60)]
    rows = []
    for i, t in items:
        w = t.split()
        for k in (4, 5, 6, 9):
            rows.append([x if p % k != k - 1 else "edit" for p, x in enumerate(w)])
        rows += [[x if r.random() > share else "edit" for x in w] for share in (0.1, 0.15, 0.2, 0.25)]
        rows += [[x for x in w if r.random() > 0.2], [y for p, x in enumerate(w) for y in ([x, "new"] if p % 2 else [x])]]
        rows += [w[: len(w) // 2] + ["new"] * (len(w) // 3) + w[len(w) // 2 :]]
        rows[-1:] = [rows[-1], rows[-1][::-1]]
    docs = [(i, " ".join(["before"] * 9 + x + ["after"] * 9)) for i, x in enumerate(rows)] + [(10_000 + i, t) for i, t in items[::2]]
    of_item = {i: words(t) for i, t in items}
    want = {}
    for d, t in docs:
        for i, x in of_item.items():
            if len(set(x.tolist()) & set(words(t).tolist())) >= len(x) / 2:
                score = float(smith_waterman(x, words(t))) / len(x)
                if score >= X.LEAST:
                    want[d, i] = round(score, 6)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(p.doc_id, p.item_id): p.score for p in X.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    assert len(want) > 400 and got == want
