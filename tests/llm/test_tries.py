import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

import tessera.llm.tries as tries
from tessera.llm.tries import NODE, ORACLE_SQL, prefix_nodes, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int, family string"


def rebuilt(rows):
    """{conv_id: [(role, text)]}; turns of one number must be of one kind here."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [u for _, u in sorted(x)] for c, x in own.items()}
    out = {}
    for c, us in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(first, [])[:h] + us[h:]
    return out


def brute(rows):
    members = defaultdict(list)
    convs = rebuilt(rows)
    for c, us in convs.items():
        for d in range(len(us) + 1):
            members[tuple(us[:d])].append(c)
    if not members:
        return []
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in below[p]) or 1
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = own + sum(saved[x] for x in below[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "f") for r in rows], SCHEMA).repartition(4)


def made(spark, rows, **how):
    out = prefix_trie(table(spark, rows), **how)
    assert out.columns == NODE and [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 7 + ["string"]
    return sorted(map(tuple, out.collect()), key=str)


def talk(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        hot = c % 3 == 0
        for t in range(r.randint(0, 7)):
            text = ["Hello there", "same  again", "x"][min(t, 2)] if hot and t < 4 else r.choice(["yes", "no no", "", None, "maybe\tso\x0bnow", "é è"])
            rows.append((c, None if t == 0 and c % 5 == 0 else t, "user" if t % 2 == 0 else r.choice(["assistant", None]), text))
    return rows


@pytest.mark.parametrize("least, largest", [(256, 200_000), (4, 200_000), (1, 3), (1, 1)])
def test_like_brute_force(spark, monkeypatch, least, largest):
    monkeypatch.setattr(tries, "LEAST", least)
    rows = talk(1)
    rows += [(c, t, "user", "copy") for c in range(1000, 1060) for t in range(5)]
    rows += [(7000, t, "user", f"{t} of a long one") for t in range(40)] + [(7001, t, "user", f"{t} of a long one") for t in range(25)]
    rows += [(-3, 0, "user", "below zero"), (-23, 1, None, None), (None, 1, "user", "of nobody"), (None, None, None, None), (9000, None, "user", ""), (9007, 5, "user", "no first one")]
    assert made(spark, rows, largest=largest) == brute(rows)


def test_every_node_parted_until_it_ends(spark, monkeypatch):
    """A hot first turn, paths that end where others go on, copies, and prefixes of a length that differs by turns."""
    monkeypatch.setattr(tries, "LEAST", 1)
    paths = {c: ["a"] * (c % 6) + (["b"] * (c % 4) if c % 2 else []) for c in range(1, 200)}
    rows = [(c, t, "user", text) for c, p in paths.items() for t, text in enumerate(p)]
    assert made(spark, rows, largest=2) == brute(rows)


def test_repeats_and_ties(spark):
    one, two = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 0][:2]
    rows = [(one, 1, "user", "b"), (one, 1, "user", "a"), (one, 1, "user", "a"), (two, 1, "user", "a"), (two, 1, "user", "b"), (two, 1, "user", "a")]
    out = {(r.depth, r.n_convs) for r in prefix_trie(table(spark, rows)).collect()}
    # Turns of one number stand in the order of their digests, so both conversations are the same one.
    assert len(out) == 4 and all(n == 2 for _, n in out)


def test_role_and_text_do_not_run_together(spark):
    ids = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 0]
    rows = [(ids[0], 0, "ab", "c"), (ids[1], 0, "a", "bc"), (ids[2], 0, "1:a", ""), (ids[3], 0, None, "1:a")]
    assert len(made(spark, rows)) == 5


def test_no_turns(spark):
    assert made(spark, []) == []
    assert made(spark, [(None, 1, "user", "x")]) == []
    # A conversation whose only turns are replaced by those of a family without a first one.
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    assert made(spark, [(c, 0, "user", "gone")]) == brute([(c, 0, "user", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_other_paths(spark):
    """The trie takes any paths: units of a digest and a number of words."""
    unit = lambda x, words: hashlib.md5(x.encode()).digest() + words.to_bytes(4, "big")
    df = spark.createDataFrame([(5, unit("a", 2) + unit("b", 3)), (2, unit("a", 2)), (9, b"")], "conv_id long, path binary")
    got = sorted(tuple(r)[:7] for r in prefix_nodes(df).select(*NODE).na.fill(-1).collect())
    assert got == sorted([(2, 0, -1, 3, 1, 1, 2), (2, 1, 2, 2, 1, 1, 2), (5, 2, 2, 1, 0, 1, 0)])


def test_sql(spark):
    rows = talk(4, 80)
    conversations = table(spark, rows).toPandas()  # noqa: F841  DuckDB reads it by name
    conversations["turn"] = conversations["turn"].astype("Int64")
    want = sorted(duckdb.sql(f"SELECT {', '.join(NODE)} FROM ({ORACLE_SQL})").fetchall(), key=str)
    assert want == brute(rows) == made(spark, rows)
