"""Logs, tables of versions, feeds of changes and keyed state: order, conflicts, restarts, expiry."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.sources import changes, objects
from tessera.sources.log import Conflict, Log
from tessera.sources.versioned import VersionedTable, judged
from tessera.streaming import state


def test_log_is_written_once(tmp_path):
    log = Log(str(tmp_path / "log"))
    assert log.last() == -1 and log.append(0, {"a": 1}) and not log.append(0, {"a": 2}) and log.read(0) == {"a": 1}
    with pytest.raises(ValueError):
        log.append(2, {})
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if log.append(1, {"who": i}) else None) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and log.read(1) == {"who": won[0]} and log.numbers() == [0, 1]
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith(".")]


def test_writes_are_judged_in_order(spark):
    r = random.Random(3)
    now, want, rows = {"a": "e0"}, {}, []
    for i in range(400):
        key, etag, match = r.choice("abc"), r.choice(["e1", "e2", "e3", None]), r.choice([None, "", "e0", "e1", "e2", "e3"])
        code = "OBJECT_TOO_LARGE" if i % 17 == 0 else None
        rows.append((key, i, match, etag, code))
        found = now.get(key)
        said = code or ("PRECONDITION_FAILED" if match and match != found else None)
        want[i] = (key, said, found)
        if said is None:
            now[key] = etag
    r.shuffle(rows)
    got = judged(spark.createDataFrame(rows, "key string, ord int, if_match string, etag string, code string").repartition(6), spark.createDataFrame([("a", "e0"), ("z", "e9")], "key string, etag string"))
    assert {x.ord: (x.key, x.code, x.found) for x in got.collect()} == want


def test_repeated_keys_in_one_batch(spark):
    none = spark.createDataFrame([], "key string, size long, last_modified timestamp, content_type string, etag string, content binary")
    new = spark.createDataFrame([("a", "one", "text/plain", None, 1), ("a", "two", "text/plain", "f97c5d29941bfb1b2fdab0874906ab82", 2), ("a", "three", "text/plain", "wrong", 3), ("b", "x" * 20, "text/plain", None, 4)], "key string, content string, content_type string, if_match string, n int")
    after, status = objects.put_objects(none, new, cap=10, order="n")
    assert [(r.key, bytes(r.content)) for r in after.collect()] == [("a", b"two")]
    assert sorted((r.n, r.status, r.code) for r in status.collect()) == [(1, "ok", None), (2, "ok", None), (3, "error", "PRECONDITION_FAILED"), (4, "error", "OBJECT_TOO_LARGE")]


def table(spark, path, rows=()):
    t = VersionedTable.create(spark, str(path), "key string, content string, etag string", "key", buckets=4)
    if rows:
        t.merge(spark.createDataFrame([(k, c, c, i) for i, (k, c) in enumerate(rows)], "key string, content string, etag string, ord int"), order="ord")
    return t


def held(t, version=None):
    return {r.key: r.content for r in t.read(version).collect()}


def test_two_writers_of_which_one_loses(spark, tmp_path):
    t = table(spark, tmp_path / "t", [("a", "1"), ("b", "1"), ("a", "2")])
    assert held(t) == {"a": "2", "b": "1"} and held(t, 0) == {}
    up = lambda c: lambda now: now.withColumn("content", F.concat("content", F.lit(c)))
    assert t.transact(up("x"), expected=1) == 2
    with pytest.raises(Conflict):
        t.transact(up("y"), expected=1)
    assert held(t) == {"a": "2x", "b": "1x"} and t.version() == 2 and held(t, 1) == {"a": "2", "b": "1"}
    # One that comes in between is seen by the writer that tries again.
    came = []

    def change(now):
        if not came:
            came.append(t.transact(up("z")))
        return now.withColumn("content", F.concat("content", F.lit("y")))

    assert t.transact(change) == 4 and held(t) == {"a": "2xzy", "b": "1xzy"}


def test_only_touched_buckets_are_made_anew(spark, tmp_path):
    t = table(spark, tmp_path / "t", [(f"k{i}", "0") for i in range(40)])
    before = t.log.read(1)["buckets"]
    t.merge(spark.createDataFrame([("k3", "1", "1", 1, False), ("k3", "2", "2", 2, True)], "key string, content string, etag string, ord int, gone boolean"), order="ord", delete="gone")
    after = t.log.read(2)["buckets"]
    assert len(held(t)) == 39 and sum(before[b] != after.get(b) for b in before) == 1
    assert t.merge(t.read().where("false").withColumn("ord", F.lit(1)), order="ord") == 2


def test_put_deletes_and_refuses(spark, tmp_path):
    t = table(spark, tmp_path / "t", [("a", "1"), ("b", "1")])
    rows = [("a", None, None, "1", 1), ("a", "n", "n", "1", 2), ("b", "m", "m", "1", 3), (None, "x", "x", None, 4), ("c", "q", "q", None, 5)]
    w = spark.createDataFrame(rows, "key string, content string, etag string, if_match string, ord int").withColumn("code", F.lit(None))
    number, said = t.put(w)
    assert number == 2 and held(t) == {"b": "m", "c": "q"} and {r.ord: r.code for r in said.collect()} == {1: None, 2: "PRECONDITION_FAILED", 3: None, 5: None}
    with pytest.raises(Conflict):
        t.put(w, expected=1)


FEED = "version long, ord long, op string, key string, value string"


def rows(spark, *some):
    return spark.createDataFrame([(v, i, "DELETE" if x is None else "UPSERT", k, x) for i, (v, k, x) in enumerate(some)], FEED)


def follow(spark, feed, t, check):
    changes.follow(changes.change_stream(spark, feed), t, check, availableNow=True).awaitTermination()
    return {r.key: r.value for r in t.read().collect()}


def test_feed_from_any_offset(spark, tmp_path):
    feed, check = str(tmp_path / "feed"), str(tmp_path / "check")
    t = VersionedTable.create(spark, str(tmp_path / "t"), "key string, value string", "key", buckets=2)
    changes.publish(rows(spark, (1, "a", "1"), (1, "a", "2"), (2, "b", "1")), feed)
    assert follow(spark, feed, t, check) == {"a": "2", "b": "1"}
    number = t.version()
    assert follow(spark, feed, t, check) == {"a": "2", "b": "1"} and t.version() == number
    changes.publish(rows(spark, (5, "b", None), (5, "c", "x")), feed)
    with pytest.raises(ValueError):
        changes.publish(rows(spark, (5, "d", "late")), feed)
    with pytest.raises(ValueError):
        changes.expire(feed, 2)
    assert follow(spark, feed, t, check) == {"a": "2", "c": "x"}
    # Away while what it needs expires: what went in the meantime must go here too.
    changes.publish(rows(spark, (7, "a", None), (8, "e", "y")), feed)
    changes.compact(spark, feed, 8)
    changes.expire(feed, 8)
    changes.publish(rows(spark, (9, "f", "z")), feed)
    assert follow(spark, feed, t, check) == {"c": "x", "e": "y", "f": "z"}
    assert {r.key: r.version for r in changes.state_at(spark, feed, 9).collect()} == {"c": 5, "e": 8, "f": 9}
    other = VersionedTable.create(spark, str(tmp_path / "u"), "key string, value string", "key", buckets=2)
    assert follow(spark, feed, other, str(tmp_path / "check2")) == {"c": "x", "e": "y", "f": "z"}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    feed = str(tmp_path / "feed")
    changes.publish(rows(spark, (1, "a", "1")), feed)
    t = VersionedTable.create(spark, str(tmp_path / "t"), "key string, value string", "key", buckets=2)
    assert follow(spark, feed, t, str(tmp_path / "c1")) == {"a": "1"} and t.version() == 1
    # A checkpoint that was lost after the table's version had been written.
    assert follow(spark, feed, t, str(tmp_path / "c2")) == {"a": "1"} and t.version() == 1


def test_offsets_of_the_reader(spark, tmp_path):
    feed = str(tmp_path / "feed")
    reader = changes._Stream({"path": feed})
    assert reader.initialOffset() == reader.latestOffset() == {"version": -1}
    changes.publish(rows(spark, (1, "a", "1"), (2, "b", "1"), (3, None, "no key")), feed)
    got = [r for p in reader.partitions({"version": 1}, {"version": 2}) for b in reader.read(p) for r in b.to_pylist()]
    assert got == [{"version": 2, "ord": 1, "op": "UPSERT", "key": "b", "value": "1"}] and reader.latestOffset() == {"version": 3}


def test_tombstones_and_their_end(spark, tmp_path):
    source, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    schema = "key string, version long, ord long, op string, value string, ts timestamp_ntz"

    def batch(*some):
        spark.createDataFrame([(k, v, o, op, x, ts) for k, v, o, op, x, ts in some], "key string, version long, ord long, op string, value string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        s = state.last_values(spark.readStream.schema(schema).parquet(source), delay="1 hour", keep=3_600_000)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {r.key: (r.value, r.deleted) for r in state.state_of(spark, check).collect()}

    assert batch(("a", 1, 1, "UPSERT", "x", "2024-01-01 00:00:00"), ("b", 1, 2, "UPSERT", "y", "2024-01-01 00:00:00"), (None, 1, 3, "UPSERT", "z", "2024-01-01 00:00:00")) == {"a": ("x", False), "b": ("y", False)}
    # Deleted, then an older change, late: the key stays away.
    assert batch(("a", 2, 1, "DELETE", None, "2024-01-01 00:10:00"), ("a", 1, 9, "UPSERT", "old", "2024-01-01 00:05:00")) == {"a": (None, True), "b": ("y", False)}
    # The watermark passes the tombstone by more than an hour; it goes, the other key stays.
    assert batch(("c", 3, 1, "UPSERT", "w", "2024-01-01 09:00:00")).keys() >= {"b", "c"}
    assert batch(("c", 3, 1, "UPSERT", "again", "2024-01-01 09:00:00")) == {"b": ("y", False), "c": ("w", False)}
    assert sorted((r.key, r.ord, r.op) for r in spark.read.parquet(out).collect()) == [("a", 1, "DELETE"), ("a", 1, "UPSERT"), ("b", 2, "UPSERT"), ("c", 1, "UPSERT")]
