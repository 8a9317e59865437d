import re

import pytest

from tessera.llm import licenses as X

from .common import awkward, empty


def brute(rows, containment=X.CONTAINMENT):
    best = {}
    for d, t in rows:
        w = X.words_in(t or "")
        for name, body in X.TEMPLATES:
            b = X.words_in(body)
            own = {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
            for k in range(0, len(w), len(b)):
                part = w[k : k + X.WIDE * len(b)]
                share = len(own & {tuple(part[i : i + 5]) for i in range(len(part) - 4)}) / len(own)
                if share >= containment:
                    old = best.get((d, name), (0, k))
                    best[d, name] = (max(old[0], round(share, 6)), min(old[1], k))
    return {(*k, *v) for k, v in best.items()}


def test_bands():
    n = X.bands_for([5, 7, 40])
    own, held = 1, 1
    assert (1 - held / (X.WIDE * 5 - 4 + own - held)) ** n <= X.MISS


def test_table(spark, monkeypatch):
    docs, rows = awkward(spark)
    mit, apache = X.TEMPLATES[5][1], X.TEMPLATES[4][1]
    edited = re.sub("merge", "combine", mit)
    more = [(300, "intro " * 37 + mit.upper()), (301, edited), (302, "x " * 5 + X.TEMPLATES[0][1] + " and " + X.TEMPLATES[3][1]), (303, " ".join(apache.split()[:20])), (302, "again"), (304, X.TEMPLATES[2][1] * 3), (305, " ".join(mit.split()[:60] + ["inserted"] * 60 + mit.split()[60:])), (306, X.TEMPLATES[6][1]), (307, X.TEMPLATES[6][1] + " " + X.TEMPLATES[7][1]), (300, mit + " tail"), (None, X.TEMPLATES[1][1])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = {tuple(r) for r in X.scan_licenses(docs).collect()}
    assert got == brute(rows + more)
    assert {(305, "MIT"), (306, "BSD-2-Clause"), (307, "BSD-2-Clause"), (307, "BSD-3-Clause")} <= {x[:2] for x in got} and (306, "BSD-3-Clause") not in {x[:2] for x in got}
    monkeypatch.setattr(X, "FEW", 1)
    assert {tuple(r) for r in X.scan_licenses(docs).collect()} == got
    assert {(300, "MIT"), (301, "MIT"), (302, "Apache-2.0"), (302, "CC-BY-NC-4.0"), (None, "MIT")} <= {x[:2] for x in got}


def test_one_text_of_many_licenses(spark, monkeypatch):
    """Windows that begin in any piece of a text, and across the ends of pieces; time grows with the text."""
    monkeypatch.setattr(X, "PIECE", 64)
    body = " ".join(f"{' '.join(f'w{i}x{j}' for j in range(i % 40))} {X.TEMPLATES[i % len(X.TEMPLATES)][1]}" for i in range(60))
    rows = [(1, body), (2, " ".join(["filler"] * 500)), (1, "the same id: " + X.TEMPLATES[3][1])]
    assert {tuple(r) for r in X.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_native_plan(spark):
    plan = X.scan_licenses(awkward(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_edges(spark):
    assert X.scan_licenses(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="words"):
        X.scan_licenses(empty(spark), [("short", "two words")])
