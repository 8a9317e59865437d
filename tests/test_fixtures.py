"""Hand-derived cases: traps, ties, errors, streams and the file source."""

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import config as C
from tessera.functions import scalars as S
from tessera.operators import agents, keysync, registry, text, vectors
from tessera.plans import federated, sql
from tessera.sources import files, objects
from tessera.streaming import keysync as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("n", "want"), [(2, "a\nb"), (0, "a\nb\na\n"), (-1, "a\nb\na"), (9, "a\nb\na\n")])
def test_head(spark, n, want):
    assert one(spark, text.head_lines(F.lit("a\nb\na\n"), n)) == want


@pytest.mark.parametrize(("n", "want"), [(2, "a\n"), (9, "a\nb\na\n"), (0, "a\nb\na\n")])
def test_tail(spark, n, want):
    assert one(spark, text.tail_lines(F.lit("a\nb\na\n"), n)) == want


def test_edits_see_earlier_edits(spark):
    df = spark.createDataFrame([(1, "a\nb\na\n")], "k int, text string")
    edits = [("a", "b"), ("b", "c")]
    assert df.select(text.edited(F.col("text"), edits)).first()[0] == "c\nc\nc\n"
    assert text.edit_log(df, edits, "k").count() == 5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab\n", max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_lines_like_python(spark, texts, n):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: (r["h"], r["l"]) for r in df.select("i", text.head_lines(F.col("t"), n).alias("h"), text.tail_lines(F.col("t"), n).alias("l")).collect()}
    assert got == {i: ("\n".join(t.split("\n")[:n]), "\n".join(t.split("\n")[-n:])) for i, t in enumerate(texts)}


def test_read_text_file(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a\nb\nc")
    assert files.read_text_file(spark, str(tmp_path / "f.txt"), head=2).first()["content"] == "a\nb"
    with pytest.raises(ValueError, match="both"):
        files.read_text_file(spark, str(tmp_path / "f.txt"), head=1, tail=1)


def test_file_source(spark, tmp_path):
    (tmp_path / "a/b/c/d").mkdir(parents=True)
    (tmp_path / "skip_me").mkdir()
    (tmp_path / "skip_me/x.txt").write_text("x")
    (tmp_path / "a/one.txt").write_text("12345")
    (tmp_path / "a/b/two.md").write_text("1")
    (tmp_path / "zero.txt").write_text("")
    root = str(tmp_path)
    listed = [tuple(r) for r in files.list_directory(spark, root, sizes=True).collect()]
    assert listed == [("a", "directory", None), ("skip_me", "directory", None), ("zero.txt", "file", 0)]
    tree = {(r["path"][len(root) :], r["depth"]) for r in files.directory_tree(spark, root, ["skip"]).collect()}
    assert tree == {("/a", 0), ("/zero.txt", 0), ("/a/b", 1), ("/a/one.txt", 1), ("/a/b/c", 2), ("/a/b/two.md", 2)}
    assert {tuple(r) for r in files.search_files(spark, root, "*.txt", ["^zero"]).collect()} == {("skip_me/x.txt", "file"), ("a/one.txt", "file")}
    (tmp_path / "zero.txt").chmod(0o644)
    info = files.file_info(spark, root + "/zero.txt").first()
    assert (info["permissions"], info["size"], info["type"]) == ("644", 0, "file")
    assert files.list_directory(spark, root + "/none").count() == 0


def test_glob():
    import re

    for g, yes, no in [("*.txt", "a.txt", "a/b.txt"), ("**/*.txt", "a/b/c.txt", "c.md"), ("a?[!x]", "abc", "abx"), ("a+b", "a+b", "aab")]:
        assert re.match(files.glob_regex(g), yes) and not re.match(files.glob_regex(g), no)


def test_containment(spark):
    df = spark.createDataFrame([("/data",), ("/data/x",), ("/data2/x",)], "p string")
    assert [r[0] for r in df.select(S.within(F.col("p"), ["/data"])).collect()] == [True, True, False]
    assert [r[0] for r in df.select(S.within(F.col("p"), ["/data"], prefix_only=True)).collect()] == [True] * 3


def test_base64_has_no_breaks(spark):
    data = bytes(range(256)) * 2
    assert one(spark, S.base64_plain(F.lit(data))) == base64.b64encode(data).decode()


def test_objects(spark):
    rows = [("t", 2, "text/plain", b"ok"), ("bad", 1, "text/plain", b"\xff"), ("big", 11, None, b"x" * 11), ("cap", 10, None, b"y" * 10)]
    o = spark.createDataFrame([(k, n, c, b) for k, n, c, b in rows], "key string, size long, content_type string, content binary").withColumn("etag", F.md5("content")).withColumn("last_modified", F.timestamp_seconds(F.lit(0)))
    got = {r["key"]: r for r in objects.get_objects(o, cap=10).collect()}
    assert (got["t"]["content"], got["t"]["encoding"]) == ("ok", "utf-8")
    assert (got["bad"]["content"], got["bad"]["encoding"]) == ("/w==", "base64")
    assert got["big"]["code"] == "OBJECT_TOO_LARGE" and got["big"]["content"] is None
    assert got["cap"]["code"] is None and got["cap"]["encoding"] == "base64"
    new = spark.createDataFrame([("t", "new", "text/plain", "wrong"), ("i", "aGk=", "image/png", None)], "key string, content string, content_type string, if_match string")
    after, status = objects.put_objects(o, new)
    assert {r["key"]: r["code"] for r in status.collect()} == {"t": "PRECONDITION_FAILED", "i": None}
    assert bytes(after.where("key = 'i'").first()["content"]) == b"hi"
    assert objects.delete_objects(after, new).count() == 3


def test_names(spark):
    assert one(spark, S.env_name_safe(F.lit("app_model3-8b"))) == "APP_MODEL3_8B"
    assert one(spark, S.env_name_safe(F.lit("3m.x"))) == "_3M_X"
    assert one(spark, S.iso_time(F.timestamp_micros(F.lit(1500000)))) == "1970-01-01T00:00:01.500000+00:00"
    assert one(spark, S.permissions(F.lit(33188))) == "644"
    assert one(spark, S.release_name(F.lit(None).cast("string"), F.lit("app"), F.lit("x" * 62))) == "x" * 62
    assert one(spark, S.general(F.lit(0.123456))) == "0.1235"
    assert one(spark, S.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, S.mime_type(F.lit("/a/b.PNG"))) == "image/png"
    assert one(spark, S.mime_type(F.lit("/a.b/c"))) == S.OCTET_STREAM


def test_render(spark):
    cfg = spark.sql("SELECT 'd.example' AS domain, named_struct('id', 'org/m-1', 'url', CAST(NULL AS STRING)) AS model")
    t = {"A": "https://x.{domain}", "B": "{model.url?}", "C": "{model.id|sanitize|upper}"}
    assert [r["value"] for r in C.env_lines(C.render_env(cfg, t)).collect()] == ["A=https://x.d.example", "B=", "C=ORG_M_1"]


def test_softmax_and_argmax(spark):
    z = F.array(*map(F.lit, (1.0, 3.0, 3.0)))
    assert one(spark, vectors.argmax(z)) == 1
    assert abs(sum(one(spark, vectors.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))) - 1) < 1e-12


def test_network(spark):
    rng = np.random.default_rng(0)
    w = {"conv1.weight": rng.normal(size=(2, 1, 3, 3)), "conv1.bias": np.zeros(2), "fc1.weight": rng.normal(size=(3, 8)), "fc1.bias": np.zeros(3), "fc2.weight": rng.normal(size=(2, 3)), "fc2.bias": np.zeros(2)}
    x = rng.normal(size=(1, 1, 4, 4))
    p = np.pad(x[0, 0], 1)
    conv = np.array([[[max(0, (p[i : i + 3, j : j + 3] * w["conv1.weight"][o, 0]).sum()) for j in range(4)] for i in range(4)] for o in range(2)])
    pool = np.array([[[conv[o, 2 * i : 2 * i + 2, 2 * j : 2 * j + 2].max() for j in range(2)] for i in range(2)] for o in range(2)]).ravel()
    want = w["fc2.weight"] @ np.maximum(w["fc1.weight"] @ pool, 0)
    assert np.allclose(vectors.forward(x, w)[0], want)
    df = spark.createDataFrame([(1, x.ravel().tolist()), (2, None), (3, [1.0])], "i int, px array<double>")
    got = {r["i"]: r for r in vectors.predict(df, w, (1, 4, 4)).collect()}
    assert got[1]["predicted_label"] == int(want.argmax()) and got[1]["error"] is None
    assert got[2]["error"] == got[3]["error"] == "Invalid image"
    assert vectors.predict(df, None, (1, 4, 4)).first()["error"] == "Model not loaded"
    assert vectors.resized(np.ones((3, 5, 1)), 2).shape == (2, 2, 1)


def test_best_epochs(spark):
    m = spark.createDataFrame([("r", "val_acc", v, i) for i, v in enumerate([0.4, 0.4, 0.5, 0.3], 1)], schemas.METRICS)
    assert [r["step"] for r in registry.running_best(m, "value", ["step"], ["run_id"]).where("is_best").orderBy("step").collect()] == [1, 3]
    assert registry.best_by_key(m, ["run_id"], "value", "step").first()["best_step"] == 3


def test_selection(spark):
    runs = spark.createDataFrame(
        [("a", "1", "FINISHED", {}, {"acc": 0.8}), ("b", "1", "FAILED", {}, {"acc": 0.9}), ("c", "1", "FINISHED", {}, {"acc": 0.8}), ("d", "1", "FINISHED", {}, {}), ("e", "2", "FINISHED", {}, {"acc": 1.0})], schemas.RUNS
    )
    assert [r["run_id"] for r in registry.search_runs(runs, "1", "FINISHED", "acc", 5).collect()] == ["a", "c"]
    v = spark.createDataFrame([("m", 1, "a", None), ("m", 2, "c", "Staging")], schemas.MODEL_VERSIONS)
    best = registry.best_with_version(runs.select("run_id"), v, "m")
    uris = {r["run_id"]: r["u"] for r in best.select("run_id", registry.model_uri(F.lit("m"), F.col("current_stage"), F.col("version"), F.col("run_id")).alias("u")).collect()}
    assert uris == {"a": "models:/m/1", "c": "models:/m/Staging", "b": "runs:/b/model", "d": "runs:/d/model", "e": "runs:/e/model"}
    assert {r["version"]: r["current_stage"] for r in registry.transition(v, "m", 1, "Staging").collect()} == {1: "Staging", 2: "Staging"}


def test_tool_calls(spark):
    df = spark.createDataFrame([(1, 'TOOL_CALL: execute_query(query="SELECT count(*) FROM t") TOOL_CALL: é_x()')], "k int, text string")
    raw = agents.tool_calls(df, ["k"]).orderBy("pos").collect()
    assert [(r["name"], r["args_text"]) for r in raw] == [("execute_query", 'query="SELECT count(*'), ("é_x", "")]
    whole = agents.parsed_calls(df, ["k"]).orderBy("pos").collect()
    assert whole[0]["args"] == {"query": "SELECT count(*) FROM t"} and whole[1]["args"] == {}
    assert agents.parse_arguments("x=__import__('os')") == {} and agents.parse_arguments("1") == {} and agents.parse_arguments("a=1, b='c'") == {"a": "1", "b": "c"}


def test_agent_loop(spark):
    df = spark.createDataFrame([(1, 0), (2, 9)], "k int, n int")
    out = agents.agent_loop(df, lambda x: x.withColumn("n", F.col("n") + 1), F.col("n") < 2, limit=5)
    assert {r["k"]: r["n"] for r in out.collect()} == {1: 2, 2: 9}


def test_hashes_like_python(spark):
    import hashlib
    import json

    m = {"b": '1"', "a": "x"}
    c = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    assert one(spark, keysync.keys_hash(c)) == hashlib.sha256(json.dumps(m, sort_keys=True).encode()).hexdigest()[:8]


def test_federated(spark):
    f = spark.createDataFrame([("B", "John", "Gold", "A105", 300, 200, "NA")], schemas.FLIGHTS)
    lines = spark.createDataFrame([("Silver members enjoy early boarding.",), ("Gold members enjoy early boarding and priority seating.",)], "value string")
    assert federated.status_lines(f, lines, "Status").first()["value"].startswith("Gold members")


def test_sql(spark):
    assert sql.execute_query(spark, "SELECT 1 AS x;; ").first()["x"] == 1
    assert sql.list_catalogs(spark).count() >= 1 and sql.list_schemas(spark).count() >= 1


def config(name, key, body=None):
    return (name, "ns", {}, body if body is not None else f'{{"Namespace": "n", "Name": "{name[-1]}", "ExternalEndpoint": {{"ApiKey": "{key}"}}}}')


def test_key_stream(spark, tmp_path):
    src, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = schemas.CONFIG_MAPS
    now = []

    def event(rows):
        now[:] = rows
        spark.createDataFrame([config("deploymentconfig-a", "x")], schema).write.mode("append").parquet(src)
        events = spark.readStream.schema(schema).parquet(src)
        snapshot = lambda: spark.createDataFrame(now, schema).withColumn("ord", F.monotonically_increasing_id())
        stream.sync_keys(spark, events, snapshot, target, check, ["ord"], availableNow=True).awaitTermination()
        return {r["env_name"]: r["api_key"] for r in stream.read_keys(spark, target).collect()}

    assert event([config("deploymentconfig-a", "1"), config("deploymentconfig-b", "2"), config("other-c", "3"), config("deploymentconfig-d", "", '{"bad')]) == {"N_A": "1", "N_B": "2"}
    assert event([config("deploymentconfig-a", "1"), config("deploymentconfig-a", "9")]) == {"N_A": "9"}
    assert event([]) == {"N_A": "9"}  # nothing found: the table stays


def test_tumbling_stream(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-03 00:00:00", "a", 4.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "in"))
    q = stream.tumbling(s).writeStream.outputMode("append").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["total"]) for r in spark.table("tumbled").collect()] == [(2, 3.0)]


def test_samples_and_sources(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "pos")
    with pytest.raises(IndexError):
        vectors.first_samples(df, "pos", 6)
    assert vectors.batched(df, "pos", 2, first_only=True).count() == 2
    order = [r.pos for r in vectors.shuffled(df, "pos", 3).collect()]
    assert sorted(order) == [0, 1, 2, 3, 4] and order == [r.pos for r in vectors.shuffled(df.repartition(3), "pos", 3).collect()]

    def broken():
        raise ConnectionError

    tables, errors = agents.load_registries([lambda: df, broken])
    assert len(tables) == 1 and errors == ["broken: ConnectionError"]
    (tmp_path / "c.json").write_text('{"domain": "d", "model": {"id": "m"}}')
    assert C.load_config(spark, str(tmp_path / "c.json")).select("model.id").first()[0] == "m"
    with pytest.raises(FileNotFoundError):
        C.load_config(spark, str(tmp_path / "none.json"))
