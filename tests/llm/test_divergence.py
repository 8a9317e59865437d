import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessera.llm.divergence import ORACLE_SQL, share, source_divergence

from .common import awkward, empty, texts


def brute(rows, least, top):
    """rows: (text, lang, source). The contract, term by term."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = [tuple(x or "" for x in r) for r in rows]
    held, count = Counter(), Counter()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        held.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {r[1] for r in rows}:
        kept = sorted(t for (x, t), n in held.items() if x == lang and n >= least)
        sources = {r[2] for r in rows if r[1] == lang}
        p = {}
        for s in sources:
            n = sum(count[lang, s, t] for t in kept)
            p[s] = {t: 1 + 1_000_000_000 * (count[lang, s, t] + 5) // (n + 5 * len(kept)) for t in kept}
        all_of = {t: sum(count[lang, s, t] for s in sources) for t in kept}
        q = {t: 1 + 1_000_000_000 * (all_of[t] + 5) // (sum(all_of.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s, t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def made(df, **how):
    out = source_divergence(df, **how)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [f.dataType.simpleString() for f in out.schema][-2:] == ["bigint", "int"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("how", [{}, {"per_block": 2}, {"per_block": 3, "cells": 4}])
def test_like_brute_force(spark, how, monkeypatch):
    import tessera.llm.divergence as d

    monkeypatch.setattr(d, "LEAST_CELLS", 8)
    ts = texts(3, 120)
    rows = [(t, ["en", "de", None][i % 3], f"s{i % 7}" if i % 11 else None) for i, t in enumerate(ts)]
    rows += [(None, "en", "none"), ("", "xx", "a"), ("zeta ZETA Öl ÖL über1über", "xx", "b"), ("Zeta Öl", "", ""), ("\x00a\x7fb É", "xx", "é"), ("a b", "xx", "ｚ"), ("a b", "xx", "\U0001f600")] * 2
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, n long, term string").repartition(5)
    assert made(df, least_docs=3, top=4, **how) == brute(rows, 3, 4)


def test_awkward_tables(spark):
    docs, rows = awkward(spark)
    got = made(docs, least_docs=5)
    assert got == brute([(t, "en", "src0") for _, t in rows], 5, 50) == []
    assert made(empty(spark)) == []


def test_hot_source(spark):
    rows = [(t, "en", "hot" if i % 3 else f"s{i}") for i, t in enumerate(texts(5, 90))]
    assert made(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=2, top=3) == brute(rows, 2, 3)


def test_share_is_exact():
    r = np.random.default_rng(1)
    total = r.integers(10, 9 * 10**15, 2000)
    count = (r.random(2000) * (total - 5)).astype(np.int64)
    assert share(count, total).tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(count.tolist(), total.tolist())]
    assert share(np.array([5]), 10).tolist() == [10**9 + 1]


def test_sql(spark):
    ts = texts(9, 150)
    rows = [(i, t if i % 29 else None, ["en", "de"][i % 2], f"s{i % 4}") for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    documents = df.toPandas()  # noqa: F841  DuckDB reads it by name
    want = sorted(duckdb.sql(f"SELECT lang, source, part, item, value, rank FROM ({ORACLE_SQL})").fetchall())
    assert made(df) == want and len(want) > 50
