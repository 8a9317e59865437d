"""Tools, pictures, data sets and streams that fail."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import png
from tessera.operators import agents, keysync, tools, vectors
from tessera.sources import catalog, files
from tessera.streaming import keysync as stream


def filtered(pixels, how):
    """A PNG of the picture whose rows are filtered by hand, row y by filter how(y)."""
    h, w, n = pixels.shape
    p, rows = pixels.astype(int), b""
    at = lambda y, x: p[y, x] if y >= 0 and x >= 0 else np.zeros(n, int)
    for y in range(h):
        k, line = how(y), []
        for x in range(w):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            best = []
            for i in range(n):
                e = int(a[i] + b[i] - c[i])
                best.append(min((int(a[i]), int(b[i]), int(c[i])), key=lambda v: abs(e - v)))
            line.append((p[y, x] - [0 * a, a, b, (a + b) // 2, np.array(best)][k]) % 256)
        rows += bytes([k]) + np.array(line, np.uint8).tobytes()
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[n]
    return png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, kind, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(rows)) + png._chunk(b"IEND", b"")


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_png(samples):
    p = np.random.default_rng(samples).integers(0, 256, (7, 5, samples), dtype=np.uint8)
    assert (png.decode(png.encode(p)) == p).all() and (png.decode(filtered(p, lambda y: y % 5)) == p).all()
    assert png.in_mode(p, 3).shape == (7, 5, 3) and png.in_mode(p, 1).shape == (7, 5, 1)
    for bad in (b"", b"text", png.encode(p)[:40], png.encode(p)[:-20] + b"x" * 20):
        with pytest.raises((ValueError, struct.error)):
            png.decode(bad)


def test_toolbox(spark, tmp_path):
    store = tmp_path / "store"
    box = tools.Toolbox(spark, [str(tmp_path / "a")], str(store))
    reg = box.registry()
    assert reg.count() == 21 and "path: string (required)" in agents.schema_text(reg).where("name = 'write_file'").first().text
    files.create_bucket(str(store), "b")
    p = f"{tmp_path}/a/x/f.txt"
    calls = [
        ("write_file", {"path": p, "content": "one\ntwo"}), ("read_multiple_files", {"paths": [p, f"{tmp_path}/a", "/etc/hosts"]}),
        ("put_object", {"bucket": "b", "key": "k/pic.png", "content": "aGk=", "content_type": "image/png"}), ("get_object", {"bucket": "b", "key": "k/pic.png"}),
        ("list_objects", {"bucket": "b", "prefix": "k/"}), ("delete_object", {"bucket": "b", "key": "k/pic.png"}), ("get_object", {"bucket": "b", "key": "k/pic.png"}),
        ("get_object", {"bucket": "b", "key": "../../a/x/f.txt"}), ("edit_file", {"path": p, "edits": [{"oldText": "t", "newText": "T"}], "dry_run": True}), ("create_directory", {"path": f"{tmp_path}/a/new"}),
        ("move_file", {"source": p, "destination": f"{tmp_path}/a2/f.txt"}), ("get_file_info", {"path": p}), ("list_allowed_directories", {}), ("read_media_file", {"path": f"{tmp_path}/a"}), ("write_file", {}),
    ]
    got = [r.result for r in box.run(calls).orderBy("pos").collect()]
    assert "Successfully wrote" in got[0] and '"success":false' in got[1] and "one\\ntwo" in got[1]
    assert '"ok"' in got[2] and '"encoding":"base64"' in got[3] and "aGk=" in got[3] and "k/pic.png" in got[4] and "NoSuchKey" in got[6]
    assert got[7].startswith("Error: Access denied") and "[DRY RUN] Changes:\\nLine 2: two -> Two" in got[8] and os.path.isdir(f"{tmp_path}/a/new")
    assert got[10].startswith("Error: Access denied") and '"size":7' in got[11] and got[13] == "[]" and got[14].startswith("Error")
    assert box.run([]).count() == 0
    with pytest.raises(KeyError):
        box.call("nothing", {})


def test_files(spark, tmp_path):
    (tmp_path / "deep/er/est").mkdir(parents=True)
    (tmp_path / "deep/er/est/p.PNG").write_bytes(b"x")
    (tmp_path / "deep/er/q.txt").write_text("q")
    os.symlink(tmp_path / "deep", tmp_path / "link")
    kinds = {r["name"]: r["type"] for r in files.directory_tree(spark, str(tmp_path), max_depth=9).collect()}
    assert kinds == {"deep": "directory", "er": "directory", "est": "directory", "p.PNG": "file", "q.txt": "file", "link": "file"}
    assert files.read_media_file(spark, f"{tmp_path}/deep/er/est").first()["mime"] == "image/png"
    assert files.upload_file(str(tmp_path), "no", f"{tmp_path}/deep/er/q.txt")["error"]
    files.move_file(f"{tmp_path}/deep/er/q.txt", f"{tmp_path}/deep/er/est/p.PNG")
    assert (tmp_path / "deep/er/est/p.PNG").read_text() == "q"


def test_models_and_sets(spark, tmp_path):
    assert vectors.load_model(f"{tmp_path}/none") is None
    out = vectors.predict_files(spark, str(tmp_path), None, 8, 1)
    assert out.columns == ["path", "predicted_label", "probabilities", "error"]
    with pytest.raises(ValueError, match="unknown"):
        catalog.get_datasets(spark, {}, "x")
    df = spark.range(10).withColumnRenamed("id", "n")
    assert [r.p for r in vectors.numbered(df, ["n"], "p").orderBy("n").collect()] == list(range(10))
    assert vectors.numbered(df.limit(0), ["n"], "p").count() == 0


def test_selector_and_watch(spark):
    df = spark.sql("SELECT map('a', '1') AS labels UNION ALL SELECT map('b', '2') UNION ALL SELECT NULL")
    n = lambda s: keysync.selected(df, s).count()
    assert (n(None), n("a=1"), n("a!=1"), n("a"), n("!a"), n("a=1,b=2"), n("a==1")) == (3, 1, 2, 1, 2, 0, 1)
    said = []

    def start():
        raise ConnectionError

    with pytest.raises(ConnectionError):
        stream.watch(start, 0, said.append, attempts=2)
    assert len(said) == 2


def test_text_over_cap_is_not_read(spark, tmp_path):
    from tessera.sources import objects

    spark.sql("SELECT 'k' AS key, 5L AS size, 'text/plain' AS content_type, 'e' AS etag, CAST('hello' AS BINARY) AS content").write.parquet(f"{tmp_path}/o")
    got = objects.get_objects(spark.read.parquet(f"{tmp_path}/o"), cap=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(size,3)" in plan and got.first()["code"] == "OBJECT_TOO_LARGE"


def test_loop_with_null(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "k int, n int")
    out = agents.agent_loop(df, lambda x: x.withColumn("n", F.col("n") + 1), F.col("n") < 2, limit=5)
    assert {r["k"]: r["n"] for r in out.collect()} == {1: None, 2: 2}
