"""Small tables with every awkward row: nulls, empty and long texts, repeats, ties, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d long, k string, found string, fp string, length int, score double, `_id` string"


def texts(seed=0, n=40):
    r = random.Random(seed)
    words = [r.choice(["the", "of", "Able", "ñandú", "x1", "und", "zeta", "mu,", "nu."]) + r.choice(["", "a", "re", "ing"]) for _ in range(60)]
    passage = " ".join(r.choices(words, k=70))
    out = []
    for i in range(n):
        body = " ".join(r.choices(words, k=r.randint(0, 90)))
        if i % 3 == 0:
            body = f"{body}\n{passage} {r.choice(words)}"
        if i % 7 == 0:
            body = "again " * r.randint(1, 150) + body
        out.append(body)
    return out


def awkward(spark, n=40, seed=0):
    """A table like documents with columns that clash with names used inside the operators."""
    ts = texts(seed, n)
    rows = [(i, t) for i, t in enumerate(ts)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, " x y \x1c z"), (1004, "Long " * 3000 + ts[0]), (1005, ts[3]), (1006, ts[3]), (1007, "日本語のテキスト" * 40)]
    rows += [(5, ts[5]), (5, ts[5]), (6, ts[9] + " other text under the same id"), (None, ts[0]), (None, None), (-4, ts[6])]
    full = [(i, t, "en", "src0", len(t) if t else None, 1, "k", "f", "p", 3, 0.5, None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
