"""Filters in the files source: what is listed and looked at, counted, and that results are those without pushdown."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThan, StringEndsWith, StringStartsWith

from tessera.sources import files, objects


@pytest.fixture
def tree(tmp_path):
    for a in "abc":
        for b in range(4):
            at = tmp_path / a / f"d{b}" / "deep"
            at.mkdir(parents=True)
            for n in range(3):
                (at / f"f{n}.txt").write_text("x" * (n + 1))
            (at.parent / f"{a}{b}.md").write_text("y")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    return str(tmp_path)


def walked(monkeypatch, root, filters, **options):
    """(paths found, directories listed, entries looked at, filters left to Spark)"""
    listed, seen = [], []
    scandir, entry = os.scandir, files._entry
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(p) or scandir(p))
    monkeypatch.setattr(files, "_entry", lambda p, d: seen.append(p) or entry(p, d))
    reader = files._Reader({"path": root, **options})
    left = list(reader.pushFilters(filters))
    parts = reader.partitions()
    planned = len(listed)
    found = sorted(p for part in parts for b in reader.read(part) for p in b.column(0).to_pylist())
    monkeypatch.undo()
    return found, listed[:planned], listed[planned:], seen, left


def test_a_whole_path_opens_one_entry(tree, monkeypatch):
    at = f"{tree}/a/d1/deep/f2.txt"
    assert walked(monkeypatch, tree, [EqualTo(("path",), at)]) == ([at], [], [], [at], [])
    for gone in (f"{tree}/a/d1/../d1/a1.md", f"{tree}/link/d1/a1.md", "/etc/passwd", f"{tree}", f"{tree}/a/none"):
        found, planned, read, _, _ = walked(monkeypatch, tree, [EqualTo(("path",), gone)])
        assert not found and not planned and not read
    assert walked(monkeypatch, tree, [EqualTo(("path",), at)], exclude="deep")[0] == []
    assert walked(monkeypatch, tree, [EqualTo(("path",), at)], maxdepth="2")[0] == []


def test_a_prefix_lists_its_subtree(tree, monkeypatch):
    found, planned, read, seen, left = walked(monkeypatch, tree, [StringStartsWith(("path",), f"{tree}/b/d2/")])
    assert found == sorted([f"{tree}/b/d2/b2.md", f"{tree}/b/d2/deep", *(f"{tree}/b/d2/deep/f{n}.txt" for n in range(3))])
    assert set(planned + read) == {f"{tree}/b/d2", f"{tree}/b/d2/deep"} and len(seen) == 5 and not left
    found, planned, read, seen, _ = walked(monkeypatch, tree, [StringStartsWith(("path",), f"{tree}/b/d")])
    assert len(found) == 4 * 6 and set(planned + read) == {f"{tree}/b"} | {f"{tree}/b/d{i}" for i in range(4)} | {f"{tree}/b/d{i}/deep" for i in range(4)}
    assert walked(monkeypatch, tree, [StringStartsWith(("path",), f"{tree}/b/d2/"), StringStartsWith(("path",), f"{tree}/c/")])[0] == []
    assert len(walked(monkeypatch, tree, [StringStartsWith(("path",), "/")])[0]) == 4 + 12 * 6


def test_names_depths_and_parents(tree, monkeypatch):
    found, _, _, seen, left = walked(monkeypatch, tree, [In(("name",), ("f1.txt", "a0.md")), StringEndsWith(("path",), "t")])
    assert len(found) == 13 and len(seen) == 13 and [type(f) for f in left] == [StringEndsWith]
    found, planned, read, _, _ = walked(monkeypatch, tree, [LessThan(("depth",), 2)])
    assert len(found) == 4 + 12 and len(set(planned + read)) == 4
    found, planned, read, _, _ = walked(monkeypatch, tree, [EqualTo(("parent",), f"{tree}/c/d3")])
    assert found == [f"{tree}/c/d3/c3.md", f"{tree}/c/d3/deep"] and set(planned + read) == {f"{tree}/c/d3"}
    assert walked(monkeypatch, tree, [EqualTo(("parent",), f"{tree}/c/d3"), EqualTo(("name",), "deep")])[0] == [f"{tree}/c/d3/deep"]


CONDITIONS = [
    "name = 'f1.txt'",
    "name in ('f1.txt', 'deep') and depth <= 2",
    "path like '{root}/a/%'",
    "startswith(path, '{root}/a/d1/deep/f')",
    "path = '{root}/a/d1/a1.md'",
    "path = '{root}/a/d1/a1.md' and name = 'other'",
    "parent = '{root}/b'",
    "parent = '{root}/b' and path = '{root}/b/d1'",
    "depth = 1",
    "depth < 0",
    "size > 2 and depth < 4 and type = 'file'",
    "name = 'x' and name = 'y'",
    "startswith(path, '{root}/a') and startswith(path, '{root}/b')",
    "name = 'deep' or depth = 0",
    "path is null",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_same_rows_as_without(spark, tree, condition):
    asked = condition.replace("{root}", tree)
    every = spark.createDataFrame(files.files(spark, tree).collect(), files.FILES)
    columns = ["path", "parent", "name", "depth", "type", "link"]
    assert sorted(files.files(spark, tree).where(asked).select(*columns).collect()) == sorted(every.where(asked).select(*columns).collect())


def test_listing_by_prefix(spark, tree):
    want = {f"b/d2/deep/f{n}.txt": n + 1 for n in range(3)} | {"b/d2/b2.md": 1}
    got = objects.list_folder(spark, tree, "b/d2").collect()
    assert {r.key: r.size for r in got} == want and all(r.last_modified.startswith("20") for r in got)
    assert {r.key.split(":")[-1].split("/b/")[-1] for r in objects.scan_folder(spark, tree, "b/d2").collect()} == {k[2:] for k in want}
    assert objects.scan_folder(spark, tree, "b/d2/").count() == 4
    assert files.file_info(spark, f"{tree}/a/d1/a1.md").select("name", "size").collect() == [("a1.md", 1)]
