"""The sink with commit, and the tools as functions of SQL."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.errors import AnalysisException

from tessera.operators import table_functions
from tessera.sources import sink
from tessera.sources.log import file_system

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def held(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


def test_files_and_what_becomes_of_names(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.txt", b"1", 1), ("b/c.bin", b"\x00\xff", 1), ("a.txt", b"2", 3), ("a.txt", b"9", 2), ("empty", None, 1)], "name string, content binary, n int").repartition(4)
    sink.write_objects(rows, at, order="n")
    assert held(at) == {"a.txt": b"2", "b/c.bin": b"\x00\xff", "empty": b""}
    sink.write_objects(spark.createDataFrame([("a.txt", "new é")], "name string, text string"), at, content="text")
    assert held(at)["a.txt"] == "new é".encode() and len(held(at)) == 3
    sink.write_objects(rows.where("false"), at)
    assert len(held(at)) == 3


@pytest.mark.parametrize("name", ["../out.txt", "/etc/x", "", None, "a/../b", "_attempts/x", ".."])
def test_names_stay_below_and_a_failed_job_leaves_nothing(spark, tmp_path, name):
    at = str(tmp_path / "out")
    rows = spark.createDataFrame([("good.txt", "1"), (name, "2")], "name string, content string").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017  Spark's own, around the task's
        sink.write_objects(rows, at, distinct=True)
    assert held(at) == {} and not os.path.exists(tmp_path / "out.txt")


def test_a_task_that_fails_once_leaves_every_file_once(tmp_path):
    """In a session of its own, whose tasks may be tried again."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tessera.sources import sink
def some(batches):
    import pyarrow as pa
    from pyspark import TaskContext
    t = TaskContext.get()
    for b in batches:
        yield b
    if t.attemptNumber() == 0 and t.partitionId() % 2:
        raise OSError("lost")
rows = spark.range(0, 400, 1, 4).selectExpr("concat('f', id) AS name", "cast(id AS string) AS content").mapInArrow(some, "name string, content string")
sink.write_objects(rows, {str(tmp_path / "out")!r}, distinct=True)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
    assert done.returncode == 0 and "lost" in done.stderr
    assert held(tmp_path / "out") == {f"f{i}": str(i).encode() for i in range(400)}


def test_a_job_that_died_is_finished_or_forgotten(tmp_path):
    root = tmp_path / "out"
    for job in ("noted", "lost"):
        (root / "_attempts" / job / "0-1").mkdir(parents=True)
        (root / "_attempts" / job / "0-1" / f"{job}.txt").write_text(job)
    (root / "_attempts" / "noted" / "1-2" / "deep").mkdir(parents=True)
    (root / "_attempts" / "noted" / "1-2" / "deep" / "x").write_text("x")
    (root / "already.txt").write_text("renamed before it died")
    (root / "_journal").mkdir()
    folders = [file_system(str(root / "_attempts" / "noted" / a))[1] for a in ("0-1", "1-2", "9-9")]
    (root / "_journal" / "noted.json").write_text(json.dumps({"job": "noted", "folders": folders}))
    assert sink.recover(str(root)) == 1
    assert held(root) == {"noted.txt": b"noted", "deep/x": b"x", "already.txt": b"renamed before it died"}
    assert sink.recover(str(root)) == 0


def test_uploads(spark, tmp_path):
    (tmp_path / "store" / "b").mkdir(parents=True)
    (tmp_path / "m.bin").write_bytes(b"model")
    paths = spark.createDataFrame([(f"{tmp_path}/m.bin",), (f"{tmp_path}/none",), (None,)], "path string")
    got = sink.upload_files(spark, paths, str(tmp_path / "store"), "b").collect()
    assert [r.error is None for r in sorted(got, key=lambda r: str(r.key))] == [False, True, False]
    assert held(tmp_path / "store") == {"b/model/m.bin": b"model"}
    assert all("no bucket" in r.error for r in sink.upload_files(spark, paths, str(tmp_path / "store"), "c").collect())


def test_tools_in_sql(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("1\n2\n3")
    (tmp_path / "secret.txt").write_text("no")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "secret.txt")
    assert table_functions.register(spark, [str(tmp_path / "in")]) == ["text_lines", "edit_text", "read_text_file", "get_file_info", "list_directory"]
    one = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    at = f"{tmp_path}/in/f.txt"
    assert one(f"SELECT * FROM read_text_file('{at}')") == [("1\n2\n3", None)]
    assert one(f"SELECT content FROM read_text_file('{at}', head => 2)") == [("1\n2",)]
    assert one(f"SELECT content FROM read_text_file('{at}', tail => 1)") == [("3",)]
    for path in (tmp_path / "secret.txt", tmp_path / "in" / "link", tmp_path / "in" / ".." / "secret.txt"):
        assert "denied" in one(f"SELECT error FROM read_text_file('{path}')")[0][0]
    assert "denied" in one("SELECT error FROM get_file_info(CAST(NULL AS STRING))")[0][0]
    assert one(f"SELECT name, type, size FROM get_file_info('{at}')") == [("f.txt", "file", 5)]
    assert one(f"SELECT name, type FROM list_directory('{tmp_path}/in')") == [("f.txt", "file"), ("link", "file")]
    assert one("SELECT * FROM text_lines(CAST(NULL AS STRING))") == [] and one("SELECT * FROM text_lines('')") == [(1, "")]
    assert one("SELECT line FROM text_lines('a\nb\nc', tail => 2)") == [(2,), (3,)] and one("SELECT line FROM text_lines('a', tail => 5)") == [(1,)]
    assert one("""SELECT * FROM edit_text('a\naa', '[{"oldText": "a", "newText": "b"}]')""") == [(1, 1, "a", "b"), (1, 2, "aa", "bb")]


@pytest.mark.parametrize(
    "call",
    ["read_text_file('x', head => 1, tail => 1)", "read_text_file(1)", "text_lines('x', head => -1)", "text_lines('x', head => 'a')", "edit_text('x', 'no list')", """edit_text('x', '[{"oldText": "", "newText": "b"}]')""", "get_file_info()"],
)
def test_wrong_calls_fail_when_analysed(spark, call):
    table_functions.register(spark)
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}")


def test_arguments_that_must_be_constant(spark):
    table_functions.register(spark)
    with pytest.raises(AnalysisException):
        spark.sql("SELECT t.* FROM range(3), LATERAL text_lines('a', head => cast(id AS int)) t")
