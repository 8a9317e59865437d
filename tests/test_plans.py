"""Scans, range joins, chunks of streams, sketches and nested documents against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import documents, registry, sketches, text
from tessera.plans import joins
from tessera.plans.scan import segmented_scan
from tessera.streaming.chunks import stream_chunks


def test_scan_over_large_and_small_groups(spark):
    r = random.Random(2)
    rows = [(r.choice(["big"] * 8 + ["a", "b", None]), i, r.choice([None, *range(-5, 30)])) for i in range(600)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n int, v int").repartition(3)
    outs = {"count": ("count", None), "sum": ("sum", F.col("v")), "most": ("max", F.col("v")), "before": ("last", F.col("v"))}
    got = segmented_scan(df, ["g"], ["n"], outs, ranges=7)
    assert got.columns == ["g", "n", "v", "count", "sum", "most", "before"]
    want, seen = [], {}
    for g, n, v in sorted(rows, key=lambda x: x[1]):
        past = seen.setdefault(g, [])
        known = [x for x in past if x is not None]
        want.append((g, n, v, len(past), sum(known) if known else None, max(known) if known else None, past[-1] if past else None))
        past.append(v)
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == want
    whole = segmented_scan(df, [], ["n"], {"place": ("count", None)}, ranges=5)
    assert sorted((x.n, x.place) for x in whole.collect()) == [(i, i) for i in range(600)]
    assert segmented_scan(df.where("false"), ["g"], ["n"], outs).count() == 0


def test_one_group_is_spread_over_the_tasks(spark):
    df = spark.range(4000).select(F.lit("all").alias("g"), F.col("id").alias("n"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    out = segmented_scan(df, ["g"], ["n"], {"most": ("max", F.col("v"))}, ranges=8).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() >= 3
    best = registry.running_best(df, "v", ["n"], ["g"], large=True)
    plain = registry.running_best(df, "v", ["n"], ["g"])
    assert sorted(best.collect()) == sorted(plain.select(*best.columns).collect())


@pytest.mark.parametrize("leaves, heavy", [(1024, 20_000), (8, 3), (1, 1)])
def test_range_join_is_complete(spark, leaves, heavy):
    r = random.Random(5)
    points = [(i, r.choice([None, 7, 7, 7, 7, r.randint(0, 1000), r.randint(0, 20)])) for i in range(300)]
    spans = [(i, a, a + r.choice([0, 1, 5, 900, -3])) for i, a in enumerate(r.choices(range(1000), k=60))] + [(99, 7, 8), (98, None, 4), (97, -100, 5000)]
    p, s = spark.createDataFrame(points, "p int, at int"), spark.createDataFrame(spans, "s int, lo int, hi int")
    got = joins.contained(p, s, "at", "lo", "hi", leaves=leaves, heavy=heavy)
    assert got.columns == ["p", "at", "s", "lo", "hi"]
    want = sorted((i, x, j, lo, hi) for i, x in points for j, lo, hi in spans if x is not None and lo is not None and lo <= x < hi)
    assert sorted(map(tuple, got.collect())) == want
    assert joins.contained(p.where("false"), s, "at", "lo", "hi").count() == joins.contained(p, s.where("false"), "at", "lo", "hi").count() == 0


def test_overlaps_are_found_once(spark):
    r = random.Random(6)
    a = [(i, x, x + r.choice([0, 1, 3, 50, 400])) for i, x in enumerate(r.choices(range(200), k=80))]
    b = [(i, x, x + r.choice([0, 1, 3, 50, 400])) for i, x in enumerate(r.choices(range(200), k=80))]
    got = joins.overlapping(spark.createDataFrame(a, "i int, a0 int, a1 int"), spark.createDataFrame(b, "j int, b0 int, b1 int"), ("a0", "a1"), ("b0", "b1"), leaves=16, heavy=5)
    want = sorted((i, j) for i, a0, a1 in a for j, b0, b1 in b if a0 < a1 and b0 < b1 and a0 < b1 and b0 < a1)
    assert sorted((x.i, x.j) for x in got.collect()) == want


def test_no_key_of_the_range_join_is_heavy(spark):
    p = spark.range(5000).select(F.col("id").alias("p"), F.lit(5).alias("at"))
    s = spark.createDataFrame([(1, 0, 9), (2, 5, 6)], "s int, lo int, hi int")
    got = joins.contained(p, s, "at", "lo", "hi", heavy=100)
    assert got.count() == 10_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks_do_not_depend_on_the_batches(spark, tmp_path, seed):
    r = random.Random(seed)
    talks = {f"k{i}": [" ".join(f"w{r.randint(0, 99)}" for _ in range(r.choice([0, 1, 3, 30]))) or r.choice([None, ""]) for _ in range(r.randint(1, 9))] for i in range(8)}
    rows = [(k, i, body, i == len(parts) - 1) for k, parts in talks.items() for i, body in enumerate(parts)]
    r.shuffle(rows)
    rows += rows[:3]
    schema = "key string, part bigint, body string, last boolean"
    at = {x: str(tmp_path / x) for x in ("in", "out", "check")}
    cut = sorted(r.sample(range(len(rows)), 2))
    for some in (rows[: cut[0]], rows[cut[0] : cut[1]], rows[cut[1] :]):
        spark.createDataFrame(some, schema).coalesce(2).write.mode("append").parquet(at["in"])
        s = stream_chunks(spark.readStream.schema(schema).parquet(at["in"]), size=7, context=3)
        s.writeStream.format("parquet").option("path", at["out"]).option("checkpointLocation", at["check"]).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    ended = set(talks)
    whole = spark.createDataFrame([(k, " ".join(p or "" for p in parts)) for k, parts in talks.items()], "key string, text string")
    want = sorted(map(tuple, text.word_chunks(whole, "key", size=7, context=3).collect()))
    got = sorted(map(tuple, spark.read.schema("key string, chunk int, n_words int, body string").parquet(at["out"]).where(F.col("key").isin(*ended)).collect()))
    # A part that comes again after its key has ended begins a new one, which has no chunk of its own here unless it is part 0.
    again = {k for k, i, _, _ in rows[-3:] if i == 0}
    assert [x for x in got if x[0] not in again] == [x for x in want if x[0] not in again]


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 10).alias("day"), (F.col("id") * 2654435761 % 9973).alias("user"), (F.col("id") % 1000).cast("double").alias("value"), (F.floor(F.sqrt(F.col("id") % 2000))).cast("int").alias("item"))
    parts = sketches.sketched(df, ["day"], "user", "value")
    one = sketches.estimated(sketches.merged(parts, []), [0.0, 0.25, 0.5, 1.0]).first()
    assert one.n == 40_000 and abs(one.distinct - 9973) <= sketches.DISTINCT_ERROR * 9973
    assert all(abs(q - v) <= sketches.RANK_ERROR * 1000 + 1 for q, v in zip(one.quantiles, [0, 250, 500, 999]))
    counters = sketches.frequencies(df, ["day"], "item")
    total = sketches.merged_frequencies(counters, [])
    exact = {r.item: r["count"] for r in df.groupBy("item").count().collect()}
    asked = spark.createDataFrame([(i,) for i in [*exact, 10**6]], "item int")
    got = {r.item: r.estimate for r in sketches.looked_up(total, asked, [], "item").collect()}
    assert all(exact.get(i, 0) <= n <= exact.get(i, 0) + sketches.COUNT_ERROR * 40_000 for i, n in got.items()) and len(got) == len(exact) + 1
    assert counters.groupBy("day").count().agg(F.max("count")).first()[0] <= sketches.ROWS * sketches.WIDTH


def test_documents(spark):
    bodies = ['{"a": {"b": [1, {"c": "x"}, []], "d": null}, "e": 2.5}', "[1, 2]", "null", "7", '{"k": {}}', "{bad", None, '""']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    v = documents.parsed(df, "body")
    assert {r.i: r.problem for r in v.collect() if r.problem} == {5: "bad JSON", 6: "missing"}
    got = {(r.i, r.path): r.value for r in documents.leaves(v, "doc", ["i"]).collect()}
    assert got == {(0, "$.a.b[0]"): "1", (0, "$.a.b[1].c"): "x", (0, "$.a.b[2]"): "[]", (0, "$.a.d"): "null", (0, "$.e"): "2.5", (1, "$[0]"): "1", (1, "$[1]"): "2", (2, "$"): "null", (3, "$"): "7", (4, "$.k"): "{}", (7, "$"): ""}
    shallow = {(r.i, r.path): r.value for r in documents.leaves(v.where("i = 0"), "doc", ["i"], depth=1).collect()}
    assert json.loads(shallow[0, "$.a"]) == {"b": [1, {"c": "x"}, []], "d": None} and shallow[0, "$.e"] == "2.5"
    read = documents.fields(v, "doc", {"b": ("$.a.b[0]", "int"), "c": ("$.a.b[1].c", "int")}).collect()
    assert [(r.b, r.c) for r in read][:2] == [(1, None), (None, None)]
    assert {(r.i, r.key, r.pos) for r in documents.members(v.where("i in (0, 1)"), "doc", ["i"]).collect()} == {(0, "a", 0), (0, "e", 1), (1, None, 0), (1, None, 1)}


def test_totals_within_spans(spark):
    r = random.Random(7)
    points = [(i, r.choice([None, float("nan"), 7.0, 7.0, float(r.randint(0, 300))]), r.choice([None, *range(-9, 50)])) for i in range(300)]
    spans = [(i, float(a), float(a + r.choice([0, 1, 5, 200, -3]))) for i, a in enumerate(r.choices(range(300), k=80))] + [(99, 7.0, 8.0), (99, 7.0, 8.0), (98, None, 4.0), (97, -100.0, 5000.0), (96, 400.0, 500.0)]
    p, s = spark.createDataFrame(points, "p int, at double, v int"), spark.createDataFrame(spans, "s int, lo double, hi double")
    outs = {"n": ("count", "p"), "some": ("count", "v"), "sum": ("sum", "v"), "least": ("min", "v"), "last": ("max", "p")}
    got = joins.contained_totals(p, s, "at", "lo", "hi", outs)
    assert got.columns == ["s", "lo", "hi", *outs]
    want = []
    for j, lo, hi in spans:
        held = [(i, v) for i, x, v in points if x is not None and lo is not None and lo <= x < hi]
        known = [v for _, v in held if v is not None]
        if held:
            want.append((j, lo, hi, len(held), len(known), sum(known) if known else None, min(known, default=None), max(i for i, _ in held)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert joins.contained_totals(p.where("false"), s, "at", "lo", "hi", outs).count() == joins.contained_totals(p, s.where("false"), "at", "lo", "hi", outs).count() == 0


def test_totals_of_overlaps(spark):
    r = random.Random(8)
    a = [(i, x, x + r.choice([0, 1, 3, 50, 400])) for i, x in enumerate(r.choices(range(200), k=80))] + [(5, 3, 9), (5, 3, 9), (6, None, 9)]
    b = [(r.choice([None, i]), x, x + r.choice([-2, 0, 1, 3, 50, 400])) for i, x in enumerate(r.choices(range(200), k=80))]
    got = joins.overlapping_totals(spark.createDataFrame(a, "i int, a0 int, a1 int"), spark.createDataFrame(b, "j int, b0 int, b1 int"), ("a0", "a1"), ("b0", "b1"), "n", {"js": "j"})
    want = []
    for i, a0, a1 in a:
        met = [j for j, b0, b1 in b if a0 is not None and a0 < a1 and b0 < b1 and a0 < b1 and b0 < a1]
        if met:
            want.append((i, a0, a1, len(met), sum(j or 0 for j in met)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["range_join_points", "range_join_spans"])
def test_no_pairs_for_totals(spark, name, tmp_path, monkeypatch):
    """All rows fall in spans of one another; the queries total them without making the pairs."""
    import datetime

    from tessera import queries_state  # noqa: F401  registers its queries
    from tessera.queries import QUERIES

    def pairs(*_):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(joins, "contained", pairs)
    n = 300
    rows = [(i * 50, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i), i, "signup" if i % 2 else "error") for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.span_id: r.n for r in QUERIES[name](spark, str(tmp_path)).collect()}
    # Spans of 15 days from i on: every later point, or every error span that is open then or starts later.
    if name == "range_join_points":
        assert got == {i * 50: n - i for i in range(1, n, 2)}
    else:
        assert got == {i * 50: sum(j * 50 % 1000 > 0 and j + j * 50 % 1000 > i for j in range(0, n, 2)) for i in range(1, n, 2)}


def test_no_sketch_for_each_user(spark, tmp_path):
    import re

    from tessera.queries import QUERIES

    rows = [(i % 3, "ab"[i % 2], None if i % 7 == 0 else i) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["sql_approximate"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("a", True), ("b", True)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("functions")[0] for line in plan.splitlines() if "approx_count_distinct" in line and "keys=" in line]
    assert keys and not any(re.search(r"user_id", k) for k in keys)


@pytest.mark.parametrize("on", [[], ["k"]])
def test_streams_joined_by_time(spark, tmp_path, monkeypatch, on):
    """In batches, rows held by the few, against plain Python; rows of state are packs and a join has one store a partition."""
    import datetime

    from tessera.streaming import joins as stream_joins

    monkeypatch.setattr(stream_joins, "PACK", 40)
    monkeypatch.setattr(stream_joins, "PAIRS", 7)
    r, day = random.Random(9), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    a, b = ([(i, day + datetime.timedelta(seconds=r.choice([50, r.randint(0, 900)])), i % 3) for i in range(300)] for _ in range(2))
    at = {x: str(tmp_path / x) for x in ("a", "b", "out", "check")}
    for part in range(2):
        streams = []
        for name, rows, names in (("a", a, "i long, at timestamp, k int"), ("b", b, "j long, bt timestamp, k int")):
            spark.createDataFrame(rows[part::2], names).coalesce(1).write.mode("append").parquet(at[name])
            streams.append(spark.readStream.schema(names).parquet(at[name]))
        pairs = stream_joins.stream_interval_join(*streams, ("at", "bt"), before=20, after=60, on=on).select("i", "at", "j", "bt")
        q = pairs.writeStream.format("parquet").option("path", at["out"]).option("checkpointLocation", at["check"]).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(x.i, x.j) for x in spark.read.parquet(at["out"]).collect()]
    near = lambda x, y: datetime.timedelta(seconds=-20) < y - x < datetime.timedelta(seconds=60)
    assert sorted(got) == sorted((i, j) for i, x, k in a for j, y, m in b if near(x, y) and (not on or k == m))
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert on or most < 400
    assert not list((tmp_path / "check" / "state" / "0" / "0").glob("*keyToNumValues*"))
