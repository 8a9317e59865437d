"""Queries over files, models and streams that are made from the driver's tables, with the DuckDB SQL for their rows."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from .functions import config as C
from .functions import png
from .functions import scalars as S
from .operators import keysync, registry, text, tools, vectors
from .plans import federated, joins, sql
from .queries import _EXTRACTED, _configs, _runs, query
from .schemas import CONFIG_MAPS, FLIGHTS
from .session import read_or, register, scratch, table, written
from .sources import catalog, files, objects, sink
from .streaming import keysync as stream

# ---------------------------------------------------------------- files


def _nations(spark, d) -> str:
    """A folder for each region with a text file for each of its nations."""
    root = scratch(spark)
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()
    for r in rows:
        at = f"{root}/{r.r_name}/{r.n_name}.txt"
        files.write_file(at, f"{r.n_name}\n{r.r_name}\n{r.n_nationkey}")
        os.chmod(at, 0o640)
    return root


_NATIONS = "(SELECT n_name, r_name, n_nationkey, n_name || chr(10) || r_name || chr(10) || n_nationkey AS content FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("SELECT r_name AS name, 'directory' AS type FROM region")
def list_directory(spark, d):
    return files.list_directory(spark, _nations(spark, d))


@query(f"SELECT n_name || '.txt' AS name, 'file' AS type, CAST(strlen(content) AS BIGINT) AS size FROM {_NATIONS} WHERE r_name = 'ASIA'")
def list_directory_sizes(spark, d):
    return files.list_directory(spark, f"{_nations(spark, d)}/ASIA", sizes=True)


@query(f"""
SELECT DISTINCT r_name AS path, CAST(0 AS INTEGER) AS depth, r_name AS name, 'directory' AS type FROM {_NATIONS} WHERE NOT contains(r_name, 'EUR')
UNION ALL SELECT r_name || '/' || n_name || '.txt', 1, n_name || '.txt', 'file' FROM {_NATIONS} WHERE NOT contains(r_name, 'EUR') AND NOT contains(n_name, '_1')""")
def directory_tree(spark, d):
    root = _nations(spark, d)
    t = files.directory_tree(spark, root, ["EUR", "_1"])
    return t.select(F.substr("path", F.lit(len(root) + 2)).alias("path"), "depth", "name", "type")


@query(f"SELECT r_name || '/' || n_name || '.txt' AS path, 'file' AS type FROM {_NATIONS} WHERE n_name LIKE 'NATION_1%' AND NOT regexp_matches(n_name, '_10|5$')")
def search_files(spark, d):
    return files.search_files(spark, _nations(spark, d), "*_1*.txt", ["_10", "5[.]"])


@query(f"SELECT n_name || '.txt' AS name, 'file' AS type, CAST(strlen(content) AS BIGINT) AS size, '640' AS permissions, true AS dated FROM {_NATIONS} WHERE n_name = 'NATION_8'")
def file_info(spark, d):
    info = files.file_info(spark, f"{_nations(spark, d)}/EUROPE/NATION_8.txt")
    dated = (F.col("created") > 1.6e9) & (F.col("modified") > 1.6e9) & (F.col("accessed") > 1.6e9)
    return info.select("name", "type", "size", "permissions", dated.alias("dated"))


@query(f"SELECT n_name || '.txt' AS name, CASE WHEN n_name = 'NATION_7' THEN replace(content, 'ASIA', 'EAST') ELSE content END AS content FROM {_NATIONS} WHERE r_name = 'ASIA' UNION ALL SELECT 'new/' || 'NATION_11.txt', content FROM {_NATIONS} WHERE n_name = 'NATION_11'")
def file_writes(spark, d):
    """Writes, edits (one of them dry) and moves, then what the folder holds."""
    root = _nations(spark, d)
    box = tools.Toolbox(spark, [root])
    box.run(
        [
            ("edit_file", {"path": f"{root}/ASIA/NATION_7.txt", "edits": [{"oldText": "ASIA", "newText": "FAR"}, {"oldText": "FAR", "newText": "EAST"}]}),
            ("edit_file", {"path": f"{root}/ASIA/NATION_12.txt", "edits": [{"oldText": "A", "newText": "B"}], "dry_run": True}),
            ("move_file", {"source": f"{root}/AMERICA/NATION_11.txt", "destination": f"{root}/ASIA/new/NATION_11.txt"}),
        ]
    )
    t = spark.read.option("recursiveFileLookup", "true").text(f"{root}/ASIA", wholetext=True)
    return t.select(F.regexp_extract(F.input_file_name(), "ASIA/(.*)$", 1).alias("name"), F.col("value").alias("content"))


@query("""
SELECT * FROM (VALUES (0, 'read_text_file', 'NATION_7'), (1, 'get_object', 'text/plain'), (2, 'no_such_tool', 'no_such_tool not found'), (3, 'read_text_file', 'Error: Access denied: /etc/passwd is outside allowed directories'),
  (4, 'list_buckets', 'b1'), (5, 'execute_query', '25')) AS t(pos, name, shown)""")
def tool_invoke(spark, d):
    """Calls by name that are really run: on files, on a store, on tables, one unknown and one that isn't allowed."""
    root, store = _nations(spark, d), scratch(spark)
    files.create_bucket(store, "b1")
    files.upload_file(store, "b1", f"{root}/ASIA/NATION_7.txt")
    register(spark, d, ["nation"])
    calls = [
        ("read_text_file", {"path": f"{root}/ASIA/NATION_7.txt", "head": 1}),
        ("get_object", {"bucket": "b1", "key": "model/NATION_7.txt"}),
        ("no_such_tool", {}),
        ("read_text_file", {"path": "/etc/passwd"}),
        ("list_buckets", {}),
        ("execute_query", {"query": "SELECT count(*) AS n FROM nation;"}),
    ]
    got = tools.Toolbox(spark, [root], store).run(calls)
    field = lambda f: F.get_json_object("result", f"$[0].{f}")
    return got.select("pos", "name", F.coalesce(F.when(F.col("pos") == 0, field("content")), F.when(F.col("pos") == 1, field("content_type")), F.when(F.col("pos") == 4, field("name")), F.when(F.col("pos") == 5, field("n")), "result").alias("shown"))


@query("SELECT CAST(l.doc_id AS VARCHAR) || '.txt' AS key, CAST(strlen(text) AS BIGINT) AS size FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1")
def bucket_upload(spark, d):
    """Files written and put into a bucket by the executors, and the bucket's listing; nothing passes through the driver."""
    root, store = scratch(spark), scratch(spark)
    files.create_bucket(store, "texts")
    files.create_bucket(store, "texts")
    t = table(spark, d, "labels").where("toxic = 1").join(table(spark, d, "documents"), "doc_id")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    sink.write_objects(t.select(name.alias("name"), "text"), root, content="text", distinct=True)
    sink.upload_files(spark, t.select(F.concat(F.lit(f"{root}/"), name).alias("path")), store, "texts", prefix="")
    return objects.list_folder(spark, f"{store}/texts").select("key", "size")


# ---------------------------------------------------------------- CSV, configuration


@query("SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'EU' END AS region, p_size FROM part")
def csv_catalog(spark, d):
    """A table through CSV and the catalog: NA is a value, an empty field is null."""
    region = F.when(F.col("p_size") % 3 == 0, "NA").when(F.col("p_size") % 3 == 1, "EU")
    path = scratch(spark)
    table(spark, d, "part").select("p_partkey", "p_name", region.alias("region"), "p_size").write.csv(path, header=True)
    catalog.csv_catalog(spark, {"tessera_parts": path}, {"tessera_parts": "p_partkey long, p_name string, region string, p_size int"})
    return sql.execute_query(spark, "SELECT * FROM tessera_parts;")


# The sample tables of the question.
_FLIGHTS_CSV = """Placeholder,Name,Status,Flight,Cost_usd,Distance_km,Region
A,David,Silver,A105,600,1000,NA
B,John,Gold,A105,300,200,NA
C,Tiffany,Silver,C103,400,400,EU
D,Greg,Platinum,A105,1000,2000,EU"""
_BENEFITS = """Silver members enjoy early boarding.
Gold members enjoy early boarding and priority seating.
Platinum members enjoy early boarding, priority seating, and free flights."""


@query("SELECT 'John' AS Name, 'Gold' AS Status, 'NA' AS Region, CAST(300 AS INTEGER) AS Cost_usd, 'Gold members enjoy early boarding and priority seating.' AS value")
def federated_files(spark, d):
    """The question over a CSV file and a text file, as they lie on disk, without a line feed at their ends."""
    root = scratch(spark)
    files.write_file(f"{root}/flights.csv", _FLIGHTS_CSV)
    files.write_file(f"{root}/benefits.txt", _BENEFITS)
    flights = catalog.read_csv(spark, f"{root}/flights.csv", FLIGHTS).where("Name = 'John' and Flight = 'A105'")
    return federated.status_lines(flights, spark.read.text(f"{root}/benefits.txt"), "Status").select("Name", "Status", "Region", "Cost_usd", "value")


@query("SELECT 'P' || p_partkey || '=https://x.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '/v1' AS value FROM part")
def env_file(spark, d):
    """Environment entries written as a file of lines and read back."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("key"), F.concat(F.lit("https://x."), S.sanitize(F.col("p_brand")), F.lit("/v1")).alias("value"))
    path = scratch(spark)
    C.write_env(p, path)
    return spark.read.text(path)


_INDENTED = """'[' || chr(10) || string_agg('  {' || chr(10) || '    "name": "' || n_name || '",' || chr(10) || '    "note": ' || CASE WHEN n_nationkey % 2 = 0 THEN '"a \\\\"' || n_nationkey || '\\\\""' ELSE 'null' END || chr(10) || '  }', ',' || chr(10) ORDER BY n_nationkey) || chr(10) || ']'"""


@query(f"SELECT n_regionkey, {_INDENTED} AS shown FROM nation GROUP BY n_regionkey".replace("\\\\", "\\"))
def json_indent(spark, d):
    note = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('a "'), F.col("n_nationkey").cast("string"), F.lit('"')))
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name"), note.alias("note")))).alias("items"))
    return n.select("n_regionkey", S.indented(F.col("items"), ["name", "note"]).alias("shown"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'k' || page_id END AS token FROM pages")
def url_token(spark, d):
    i, u = F.col("page_id"), F.col("url")
    with_token = F.concat(u, F.lit("?a=1&MY_TOKEN=k"), i.cast("string"), F.when(i % 3 == 1, "&b=2").otherwise(""))
    return table(spark, d, "pages").select("page_id", S.token_of(F.when(i % 3 == 0, u).otherwise(with_token), "MY_TOKEN").alias("token"))


@query("SELECT c_custkey, format('{:.4g}', (c_acctbal + 1001) / 12000) AS shown FROM customer")
def format_general(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.general((F.col("c_acctbal") + 1001) / 12000).alias("shown"))


@query("SELECT doc_id FROM documents WHERE n_chars > 100")
def cache_or_source(spark, d):
    """A cache that isn't there, one that is no Parquet, and what both were filled from."""
    broken = scratch(spark)
    files.write_file(f"{broken}/part.parquet", "no parquet")
    source = f"{d}/documents.parquet"
    first, second = read_or(spark, scratch(spark), source), read_or(spark, broken, source)
    return first.where("n_chars > 100").select("doc_id").intersectAll(second.select("doc_id"))


@query("SELECT split, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels, CAST(3 AS INTEGER) AS channels FROM (SELECT CASE WHEN vec_id % 10 < 8 THEN 'train' WHEN vec_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, label FROM embeddings) GROUP BY split")
def dataset_splits(spark, d):
    path, i = scratch(spark), F.col("vec_id") % 10
    table(spark, d, "embeddings").select("vec_id", "label", F.when(i < 8, "train").when(i == 8, "val").otherwise("test").alias("split")).write.parquet(path)
    known = {"vectors": catalog.Dataset(path, 3, tuple("0123456789"))}
    train, val, test, info = catalog.get_datasets(spark, known, "vectors")
    both = train.unionByName(val).unionByName(test)
    return both.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("labels")).withColumn("channels", F.lit(info.channels))


# ---------------------------------------------------------------- models


def _weights(channels: int = 1) -> dict[str, np.ndarray]:
    """A network whose numbers SQL can follow: the convolution passes the (first) channel, the dense layers are small integers."""
    w = np.zeros((1, channels, 3, 3))
    w[0, 0, 1, 1] = 1
    fc1 = np.array([[float(i % 3 == k) for i in range(16)] for k in range(3)])
    fc2 = np.array([[float((c * 7 + k * 3) % 5 - 2) for k in range(3)] for c in range(10)])
    return {"conv1.weight": w, "conv1.bias": np.zeros(1), "fc1.weight": fc1, "fc1.bias": np.array([0.0, 0.5, -0.25]), "fc2.weight": fc2, "fc2.bias": np.arange(10) / 100}


def _network_sql(source: str) -> str:
    """source: (k, x list of 64 doubles) as SQL; adds z, the ten logits, label and p."""
    cells = ", ".join(f"greatest(0, x[{16 * i + 2 * j + 1}], x[{16 * i + 2 * j + 2}], x[{16 * i + 2 * j + 9}], x[{16 * i + 2 * j + 10}])" for i in range(4) for j in range(4))
    sums = ", ".join(f"greatest(0, {' + '.join(f'c[{i + 1}]' for i in range(16) if i % 3 == k)} + {b})" for k, b in enumerate((0.0, 0.5, -0.25)))
    logits = ", ".join(" + ".join(f"{float((c * 7 + k * 3) % 5 - 2)}::DOUBLE * h[{k + 1}]" for k in range(3)) + f" + {c / 100}::DOUBLE" for c in range(10))
    return f"""s AS ({source}), c AS (SELECT *, [{cells}] AS c FROM s), h AS (SELECT *, [{sums}] AS h FROM c), z AS (SELECT *, [{logits}] AS z FROM h),
e AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z), p AS (SELECT *, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS label_, list_max(e) / list_sum(e) AS top FROM e)"""


_DOUBLES = "SELECT vec_id AS k, label AS target, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings"


@query(f"WITH {_network_sql(_DOUBLES)} SELECT k AS vec_id, label_ AS predicted_label, round(top, 6) AS probability FROM p")
def predict_table(spark, d):
    """The network as a function over a table, its weights saved and loaded."""
    path = scratch(spark)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    vectors.save_model(_weights(), path)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("px"))
    out = vectors.predict(e, vectors.load_model(path), (1, 8, 8))
    return out.select("vec_id", "predicted_label", F.round(F.array_max("probabilities"), 6).alias("probability"))


@query(f"""
WITH {_network_sql(_DOUBLES)}, w AS (SELECT unnest([3, 10, 999999, 17, -1]) AS id)
SELECT CAST(id AS BIGINT) AS vec_id, label_ AS predicted_label, target AS target_label, CASE WHEN k IS NULL THEN 'file_id ' || id || ' out of range' END AS error, CASE WHEN k IS NULL THEN 400 END AS code FROM w LEFT JOIN p ON k = id""")
def predict_by_id(spark, d):
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in (3, 10, 999999, 17, -1)])).alias("vec_id"))
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("px"))
    return vectors.predict_ids(wanted, e, _weights(), (1, 8, 8), "vec_id").drop("probabilities")


_GREYS = "list_transform(embedding, lambda v: (CAST(floor(abs(CAST(v AS DOUBLE)) * 400) AS BIGINT)) % (CASE WHEN vec_id % 2 = 0 THEN 256 ELSE 100 END))"
_PIXELS = f"SELECT vec_id AS k, label AS target, CASE WHEN list_max(g) > 128 THEN list_transform(g, lambda v: (v / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE) ELSE list_transform(g, lambda v: CAST(v AS DOUBLE)) END AS x FROM (SELECT vec_id, label, {_GREYS} AS g FROM embeddings)"


def _greys(spark, d):
    """(vec_id, label, sample, content): each vector as a grey picture of 8 x 8 in PNG."""
    most = F.when(F.col("vec_id") % 2 == 0, 256).otherwise(100)
    g = F.transform("embedding", lambda v: (F.floor(F.abs(v.cast("double")) * 400) % most).cast("int"))

    @F.pandas_udf("binary")
    def made(px):
        return px.map(lambda p: png.encode(np.asarray(p, np.uint8).reshape(8, 8, 1)))

    return table(spark, d, "embeddings").select("vec_id", "label", S.padded_id(F.col("vec_id")).alias("sample"), made(g).alias("content"))


@query(f"WITH {_network_sql(_PIXELS)} SELECT printf('%06d.png', k) AS name, label_ AS predicted_label, round(top, 6) AS probability, CAST(NULL AS VARCHAR) AS error FROM p UNION ALL SELECT 'broken.png', NULL, NULL, 'Failed to process image: no PNG'")
def predict_pictures(spark, d):
    """Pictures written as files with their labels, read, decoded, prepared and judged; one of them is broken."""
    root, g = scratch(spark), _greys(spark, d)
    files.write_images(g, root)
    files.write_file(f"{root}/broken.png", "no picture")
    out = vectors.predict_files(spark, root, _weights(), 8, 1)
    return out.select(S.basename(F.col("path")).alias("name"), "predicted_label", F.round(F.array_max("probabilities"), 6).alias("probability"), "error")


@query("SELECT printf('%06d', vec_id) AS sample, label FROM embeddings")
def picture_labels(spark, d):
    path = scratch(spark)
    files.write_labels(_greys(spark, d), path)
    return catalog.read_csv(spark, path, "sample string, label int")


@query("""
SELECT vec_id, CAST(i AS INTEGER) AS pos, CAST((19595 * g[3 * i + 1] + 38470 * g[3 * i + 2] + 7471 * g[3 * i + 3] + 32768) // 65536 AS INTEGER) AS grey
FROM (SELECT vec_id, unnest(range(0, 21)) AS i, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 400) AS BIGINT) % 256) AS g FROM embeddings)""")
def grey_pictures(spark, d):
    """Colour pictures of 3 x 7 pixels brought to grey through PNG."""
    g = F.transform(F.slice("embedding", 1, 63), lambda v: (F.floor(F.abs(v.cast("double")) * 400) % 256).cast("int"))

    @F.pandas_udf("array<int>")
    def grey(px):
        return px.map(lambda p: png.in_mode(png.decode(png.encode(np.asarray(p, np.uint8).reshape(3, 7, 3))), 1).ravel().tolist())

    return table(spark, d, "embeddings").select("vec_id", F.posexplode(grey(g)).alias("pos", "grey"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'fetch' WHEN vec_id % 3 = 1 THEN 'process' END AS failed FROM embeddings")
def fetch_pictures(spark, d):
    """Pictures by address: some aren't there, some are no pictures; each failure is its row's error."""
    root, i = scratch(spark), F.col("vec_id") % 3
    g = _greys(spark, d).withColumn("content", F.when(i == 1, F.lit(b"text")).otherwise(F.col("content")))
    files.write_images(g.where(i != 0), root)
    got = vectors.fetched(g.select("vec_id", F.concat(F.lit(f"file://{root}/"), "sample", F.lit(".png")).alias("url")), "url")
    read = vectors.pixels_of(got.withColumnRenamed("error", "_fetch"), "content", 8, 1)
    error = F.coalesce("_fetch", "error")
    return read.select("vec_id", F.regexp_extract(error, "^Failed to (fetch|process)", 1).alias("failed")).withColumn("failed", F.nullif("failed", F.lit("")))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 128")
def first_batch(spark, d):
    return vectors.batched(table(spark, d, "embeddings"), "vec_id", first_only=True).select("vec_id", "label")


@query("SELECT count(*) AS n, count(DISTINCT place) AS places, CAST(min(place) AS BIGINT) AS least, CAST(max(place) AS BIGINT) AS most FROM (SELECT row_number() OVER () - 1 AS place FROM embeddings)")
def shuffled_samples(spark, d):
    """A seeded order in which every row has one place."""
    e = table(spark, d, "embeddings").select("vec_id").withColumn("key", F.xxhash64("vec_id", F.lit(7)))
    placed = vectors.numbered(e, ["key", "vec_id"], "place")
    return placed.agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.min("place").alias("least"), F.max("place").alias("most"))


@query("""
WITH b AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 128 AS b, value FROM events), m AS (SELECT b, avg(value) AS m FROM b GROUP BY b)
SELECT count(*) AS n_batches, round(avg(m), 6) AS mean FROM m""")
def mean_of_all_batches(spark, d):
    m = vectors.mean_of_batch_means(table(spark, d, "events"), "value", ["ts", "event_id"])
    return m.select("n_batches", F.round("mean", 6).alias("mean"))


# ---------------------------------------------------------------- runs, rails, conditions


@query("""
SELECT 'r' || o_orderkey AS run_id, 'deleted' AS status, CAST(NULL AS VARCHAR) AS error FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'none' || o_orderkey, 'error', 'no run none' || o_orderkey FROM orders WHERE o_orderkey % 50 = 1""")
def delete_runs_status(spark, d):
    o, key = table(spark, d, "orders"), F.col("o_orderkey").cast("string")
    ids = o.where("o_orderkey % 50 = 0").select(F.concat(F.lit("r"), key).alias("run_id")).unionByName(o.where("o_orderkey % 50 = 1").select(F.concat(F.lit("none"), key).alias("run_id")))
    return registry.delete_runs_checked(_runs(spark, d), ids)[1]


@query("SELECT 'r' || o_orderkey AS run_id, CAST(o_custkey % 7 AS VARCHAR) AS batch, CASE WHEN o_orderkey % 4 = 0 THEN '0.001' END AS lr FROM orders")
def log_params(spark, d):
    """Parameters logged to runs; the second value of one is ignored."""
    r = _runs(spark, d)
    some = r.where(F.substring("run_id", 2, 20).cast("long") % 4 == 0)
    new = some.select("run_id", F.lit("lr").alias("key"), F.lit("0.001").alias("value")).unionByName(some.select("run_id", F.lit("batch").alias("key"), F.lit("99").alias("value")))
    return registry.log_params(r, new).select("run_id", F.col("params")["batch"].alias("batch"), F.try_element_at("params", F.lit("lr")).alias("lr"))


@query("SELECT user_id, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps FROM (SELECT user_id, event_id AS step FROM events UNION ALL SELECT user_id, -1 FROM events WHERE event_type = 'click') GROUP BY user_id")
def log_metrics(spark, d):
    e = table(spark, d, "events").select("user_id", F.lit("v").alias("key"), "value", F.col("event_id").alias("step"))
    more = table(spark, d, "events").where("event_type = 'click'").select("value", F.lit(-1).cast("long").alias("step"), "user_id", F.lit("v").alias("key"))
    return registry.log_metrics(e, more).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("step").alias("steps"))


@query("SELECT doc_id AS run_id, source AS path, CASE WHEN quality = 1 THEN 'kept ' || lang ELSE lang END AS content FROM documents LEFT JOIN labels USING (doc_id)")
def log_artifacts(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.col("source").alias("path"), F.col("lang").alias("content"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("run_id"))
    return registry.log_artifacts(a, a.join(good, "run_id").withColumn("content", F.concat(F.lit("kept "), "content")))


@query("""
SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN 'length' WHEN contains(lower(text), 'the') THEN 'words' WHEN turn % 5 = 3 THEN 'self check' END AS reason,
  coalesce(length(text) > 400 OR contains(lower(text), 'the') OR turn % 5 = 3, false) AS blocked FROM conversations WHERE role = 'assistant'""")
def output_rails(spark, d):
    """Checks of what the assistant says, one after the other."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    checks = [("length", F.length("text") > 400), ("words", F.contains(F.lower("text"), F.lit("the"))), ("self check", F.col("turn") % 5 == 3)]
    return text.rails(c, checks).select("conv_id", "turn", "reason", "blocked")


@query("SELECT doc_id, coalesce(len(list_filter(string_split(text, ' '), lambda w: length(w) > 12)) > 0, false) AS long_word FROM documents")
def any_element(spark, d):
    return table(spark, d, "documents").select("doc_id", text.any_of(F.split("text", " ", -1), lambda w: F.length(w) > 12).alias("long_word"))


@query("SELECT user_id, coalesce(bool_or(event_type = 'purchase' AND value > 50), false) AS found FROM events GROUP BY user_id")
def any_row(spark, d):
    return text.any_by(table(spark, d, "events"), ["user_id"], (F.col("event_type") == "purchase") & (F.col("value") > 50))


# ---------------------------------------------------------------- joins and types


@query("""
SELECT a.event_id AS event_id, b.event_id AS other_id FROM events a JOIN events b ON a.event_type = 'error' AND b.event_type = 'purchase' AND epoch_us(b.ts) < epoch_us(a.ts) + 1800000000 AND epoch_us(a.ts) < epoch_us(b.ts) + 600000000""")
def interval_join(spark, d):
    """Errors and purchases whose spans of half an hour and ten minutes overlap."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    a = e.where("event_type = 'error'").select("event_id", at("ts").alias("s"))
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("other_id"), at("ts").alias("o"))
    j = joins.interval_join(a, b, (F.col("s"), F.col("s") + 1800), (F.col("o"), F.col("o") + 600), 1800)
    return j.select("event_id", "other_id")


_TYPES = """SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS VARCHAR(40)) AS revenue, min(l_shipdate + INTERVAL 1 MONTH) AS first_due,
CAST(count(CASE WHEN l_shipdate > TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 DAY THEN 1 END) AS BIGINT) AS late FROM lineitem GROUP BY l_returnflag"""


@query(_TYPES)
def sql_decimals(spark, d):
    register(spark, d, ["lineitem"])
    return sql.execute_query(spark, _TYPES.replace("VARCHAR(40)", "STRING"))


@query("SELECT unnest(['default']) AS namespace")
def sql_list_schemas(spark, d):
    return sql.list_schemas(spark).where("namespace = 'default'")


@query("SELECT 'spark_catalog' AS catalog")
def sql_list_catalogs(spark, d):
    return sql.list_catalogs(spark).where("catalog = 'spark_catalog'")


# ---------------------------------------------------------------- configuration maps and streams


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 3 <> 1 AND event_id % 2 = 0")
def label_selector(spark, d):
    e = table(spark, d, "events")
    labels = F.map_filter(F.create_map(F.lit("app"), F.col("event_type"), F.lit("tier"), (F.col("user_id") % 3).cast("string"), F.lit("even"), F.when(F.col("event_id") % 2 == 0, "yes")), lambda _, v: v.isNotNull())
    return keysync.selected(e.select("event_id", labels.alias("labels")), "app=click, tier!=1, even").select("event_id")


def _maps(spark, d):
    return written(_configs(spark, d).select("name", F.lit("ns").alias("namespace"), F.create_map(F.lit("app"), F.lit("models")).alias("labels"), "deploymentConfig", "event_id"))


@query(_EXTRACTED + " SELECT env_name, arg_max(api_key, event_id) AS api_key FROM e WHERE problem IS NULL GROUP BY env_name")
def key_stream(spark, d):
    """The key table after an initial snapshot, and a stream that fails once and goes on."""
    maps, events, target, check = _maps(spark, d), scratch(spark), scratch(spark), scratch(spark)
    maps.select("name", "namespace", "labels", "deploymentConfig").where("event_id % 100 = 1").write.parquet(events)
    tried = []

    def snapshot():
        tried.append(1)
        if len(tried) == 2:
            raise ConnectionError("the store is away")
        return maps.where("event_id % 2 = 0") if len(tried) == 1 else maps

    def start():
        return stream.sync_keys(spark, spark.readStream.schema(CONFIG_MAPS).parquet(events), snapshot, target, check, ["event_id"], selector="app=models", initial=not tried, availableNow=True)

    stream.watch(start, pause=0.1, log=lambda _: None, attempts=3)
    return stream.read_keys(spark, target).select("env_name", "api_key")


@query(_EXTRACTED + " SELECT env_name, arg_max(api_key, event_id) AS api_key FROM e WHERE problem IS NULL AND event_id % 2 = 0 GROUP BY env_name")
def key_stream_last_removed(spark, d):
    """Deletes: a snapshot without any key leaves the table as it was."""
    maps, events, target, check = _maps(spark, d), scratch(spark), scratch(spark), scratch(spark)
    maps.select("name", "namespace", "labels", "deploymentConfig").where("event_id % 100 = 1").write.parquet(events)
    seen = []

    def snapshot():
        seen.append(1)
        return maps.where("event_id % 2 = 0") if len(seen) == 1 else maps.where("false")

    stream.sync_keys(spark, spark.readStream.schema(CONFIG_MAPS).parquet(events), snapshot, target, check, ["event_id"], availableNow=True).awaitTermination()
    return stream.read_keys(spark, target).select("env_name", "api_key")


@query("""
WITH m AS (SELECT max(ts) FILTER (event_id % 2 = 0) - INTERVAL 1 HOUR AS first, max(ts) - INTERVAL 1 HOUR AS last FROM events),
e AS (SELECT date_trunc('day', ts) AS start, event_type, event_id, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e, m WHERE (event_id % 2 = 0 OR start + INTERVAL 1 DAY > first) AND start + INTERVAL 1 DAY <= last GROUP BY start, event_type""")
def stream_late(spark, d):
    """Windows of a stream in two parts: rows of the second that come after their window was closed are dropped, and only
    closed windows come out."""
    source, target, check = scratch(spark), scratch(spark), scratch(spark)
    e = table(spark, d, "events").select("ts", "event_type", "value", "event_id")
    schema = e.schema
    for part in (0, 1):
        e.where(f"event_id % 2 = {part}").coalesce(1).write.mode("append").parquet(source)
        w = stream.tumbling(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", check)
        w.trigger(availableNow=True).start().awaitTermination()
    t = spark.read.parquet(target)
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT conv_id, turn, CASE WHEN n0 < 3 THEN 3 ELSE n0 END AS n FROM (SELECT conv_id, turn, turn % 6 AS n0 FROM conversations)")
def agent_passes(spark, d):
    """A loop that works on what is pending, three passes at most."""
    from .operators.agents import agent_loop

    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 6).alias("n"))
    return agent_loop(c, lambda x: x.withColumn("n", F.col("n") + 1), F.col("n") < 3, limit=3)
