"""Every operator as a query over the driver's tables, with the DuckDB SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import config as C
from .functions import scalars as S
from .operators import agents, keysync, registry, text, vectors
from .plans import federated, sql
from .session import register, ship, table
from .sources import files, objects
from .streaming.keysync import tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query by its function's name; the workers get this package before it runs."""

    def add(f):
        @wraps(f)
        def run(spark, d):
            ship(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- texts and files


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS content FROM documents")
def read_head_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.head_lines(F.col("text"), 3).alias("content"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[-3:], chr(10)) AS content FROM documents")
def read_tail_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tail_lines(F.col("text"), 3).alias("content"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), u AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS b0 FROM l),
s AS (SELECT doc_id, line, b0, replace(b0, 'the', 'THE') AS b1, replace(replace(b0, 'the', 'THE'), 'THE a', 'THE_A') AS b2 FROM u)
SELECT doc_id, CAST(1 AS INTEGER) AS edit, CAST(line AS INTEGER) AS line, b0 AS before, b1 AS after FROM s WHERE contains(b0, 'the')
UNION ALL SELECT doc_id, 2, CAST(line AS INTEGER), b1, b2 FROM s WHERE contains(b1, 'THE a')""")
def edit_lines_log(spark, d):
    return text.edit_log(table(spark, d, "documents"), [("the", "THE"), ("THE a", "THE_A")], "doc_id")


@query("SELECT doc_id, replace(replace(text, 'the', 'THE'), 'THE a', 'THE_A') AS content FROM documents")
def edit_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.edited(F.col("text"), [("the", "THE"), ("THE a", "THE_A")]).alias("content"))


_WANTED = [3, 1, 999999999, 17, 3, 64]


@query("""
WITH w AS (SELECT unnest(range(0, 6)) AS pos, unnest([3, 1, 999999999, 17, 3, 64]) AS doc_id)
SELECT CAST(pos AS INTEGER) AS pos, CAST(w.doc_id AS BIGINT) AS doc_id, t.doc_id IS NOT NULL AS success, t.text AS content, CASE WHEN t.doc_id IS NULL THEN 'not found' END AS error
FROM w LEFT JOIN documents t ON t.doc_id = w.doc_id""")
def multi_read(spark, d):
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in _WANTED])).alias("pos", "doc_id"))
    return files.read_many(wanted, table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, to_base64(encode(text)) AS data FROM documents")
def object_base64(spark, d):
    return table(spark, d, "documents").select("doc_id", S.base64_plain(F.encode("text", "UTF-8")).alias("data"))


_PAGES_AS_OBJECTS = "strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(page_id AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def _page_objects(spark, d):
    p = table(spark, d, "pages")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    return p.select(F.col("url").alias("key"), F.octet_length("html").cast("long").alias("size"), at.alias("last_modified"))


@query(f"SELECT url AS key, CAST(strlen(html) AS BIGINT) AS size, {_PAGES_AS_OBJECTS} AS last_modified FROM pages WHERE starts_with(url, 'https://')")
def object_list_prefix(spark, d):
    return objects.list_objects(_page_objects(spark, d), "https://")


@query(f"SELECT string_split(url, '/')[1] AS name, min({_PAGES_AS_OBJECTS}) AS creation_date FROM pages GROUP BY 1")
def object_buckets(spark, d):
    return objects.list_buckets(_page_objects(spark, d))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN strlen(text) > 3000 THEN NULL WHEN doc_id % 3 = 2 THEN to_base64(encode(text)) ELSE text END AS content,
  CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/json' ELSE 'application/octet-stream' END AS content_type,
  CASE WHEN strlen(text) > 3000 THEN NULL WHEN doc_id % 3 = 2 THEN 'base64' ELSE 'utf-8' END AS encoding, md5(text) AS etag,
  CASE WHEN strlen(text) > 3000 THEN 'Object larger than 3000 bytes' END AS error, CASE WHEN strlen(text) > 3000 THEN 'OBJECT_TOO_LARGE' END AS code FROM documents""")
def object_get_gate(spark, d):
    t = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "text/plain").when(F.col("doc_id") % 3 == 1, "application/json")
    o = t.select(F.col("doc_id").cast("string").alias("key"), F.octet_length("text").cast("long").alias("size"), kind.alias("content_type"), F.md5("text").alias("etag"), F.encode("text", "UTF-8").alias("content"))
    return objects.get_objects(o, cap=3000)


@query("""
WITH n AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN md5(text) WHEN doc_id % 4 = 1 THEN 'x' END AS if_match FROM documents WHERE doc_id % 2 = 0 OR doc_id % 4 = 1)
SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN if_match = 'x' THEN 'error' ELSE 'ok' END AS status, CASE WHEN if_match = 'x' THEN 'PRECONDITION_FAILED' END AS code FROM n""")
def object_put_status(spark, d):
    return objects.put_objects(*_puts(spark, d))[1]


@query("""
SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 2 = 0 THEN md5('new ' || doc_id) ELSE md5(text) END AS etag FROM documents""")
def object_put_table(spark, d):
    return objects.put_objects(*_puts(spark, d))[0].select("key", "etag")


def _puts(spark, d):
    t, i = table(spark, d, "documents"), F.col("doc_id") % 4
    old = t.select(F.col("doc_id").cast("string").alias("key"), F.octet_length("text").cast("long").alias("size"), F.timestamp_seconds(F.lit(0)).alias("last_modified"), F.lit("text/plain").alias("content_type"), F.md5("text").alias("etag"), F.encode("text", "UTF-8").alias("content"))
    new = t.where((F.col("doc_id") % 2 == 0) | (i == 1)).select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("content"), F.lit("text/plain").alias("content_type"), F.when(i == 0, F.md5("text")).when(i == 1, F.lit("x")).alias("if_match"))
    return old, new


@query("SELECT url AS key, CAST(page_id AS BIGINT) AS page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id % 5 = 0)")
def object_delete(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("key"), "page_id")
    return objects.delete_objects(p, p.where("page_id % 5 = 0"))


@query("""
SELECT page_id, mime, mime LIKE 'image/%' OR mime LIKE 'audio/%' AS media FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'audio/mpeg' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/json' ELSE 'application/octet-stream' END AS mime FROM pages)""")
def media_filter(spark, d):
    names = F.concat(F.lit("/data/f"), F.col("page_id").cast("string"), F.get(F.array(*map(F.lit, (".png", ".MP3", ".txt", ".json", ""))), (F.col("page_id") % 5).cast("int")))
    p = table(spark, d, "pages").select("page_id", S.mime_type(names).alias("mime"))
    return p.withColumn("media", S.is_media(F.col("mime")))


@query("""
WITH p AS (SELECT list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages), k AS (SELECT p, unnest(range(1, least(len(p), 3) + 1)) AS k FROM p)
SELECT array_to_string(p[1:k], '/') AS prefix, CAST(k - 1 AS INTEGER) AS depth, count(*) AS n FROM k GROUP BY 1, 2""")
def dir_tree_depth(spark, d):
    return files.tree_from_paths(table(spark, d, "pages"), "url", 2)


@query("SELECT lang, source, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM documents GROUP BY ROLLUP (lang, source)")
def dir_inventory(spark, d):
    return files.inventory(table(spark, d, "documents"), ["lang", "source"], "n_chars")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(^|/)[^/]*1[^/]*$') AND NOT regexp_matches(string_split(url, '/')[-1], 'page|top')")
def search_glob(spark, d):
    return files.matching(table(spark, d, "pages").select("page_id", "url"), "url", "*1*", ["page", "top"])


@query("SELECT page_id, 'model/' || string_split(url, '/')[-1] AS key FROM pages")
def object_key_basename(spark, d):
    return table(spark, d, "pages").select("page_id", S.object_key(F.col("url")).alias("key"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/?].*', '') AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", S.host_of(F.col("url")).alias("host"))


@query("SELECT page_id, (url = 'http:' OR starts_with(url, 'http:/')) AS inside, starts_with(url, 'http') AS by_prefix FROM pages")
def path_containment(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", S.within(u, ["http:"]).alias("inside"), S.within(u, ["http"], prefix_only=True).alias("by_prefix"))


@query("""
SELECT a.path AS directory, count(*) AS n FROM (SELECT '/data/' || r_name AS path FROM region WHERE r_regionkey % 2 = 0) a
JOIN customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ON '/data/' || r_name = a.path GROUP BY a.path""")
def allowed_directories(spark, d):
    """The directories that are allowed, and how many of the customers' paths lie in each; others are left out."""
    allowed = [r[0] for r in table(spark, d, "region").where("r_regionkey % 2 = 0").select(F.concat(F.lit("/data/"), "r_name")).collect()]
    at = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = files.allowed_only(at.select(F.concat_ws("/", F.lit("/data"), "r_name", "n_name", F.col("c_custkey").cast("string")).alias("p")), "p", allowed)
    n = paths.groupBy(F.substring_index("p", "/", 3).alias("path")).agg(F.count("*").alias("n"))
    return files.allowed_directories(spark, allowed).join(n, "path").select(F.col("path").alias("directory"), "n")


@query("SELECT doc_id, 'train' AS split FROM documents WHERE doc_id % 10 < 8")
def split_scan(spark, d):
    i = F.col("doc_id") % 10
    t = table(spark, d, "documents").select("doc_id", F.when(i < 8, "train").when(i == 8, "val").otherwise("test").alias("split"))
    return files.split_scan(t, "train")


@query("SELECT doc_id, printf('%06d', doc_id) AS sample FROM documents")
def sample_id_pad(spark, d):
    return table(spark, d, "documents").select("doc_id", S.padded_id(F.col("doc_id")).alias("sample"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 200 + 1)) AS chunk FROM w)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(w[greatest(1, chunk * 200 - 49):chunk * 200 + 200]) AS INTEGER) AS n_words, array_to_string(w[greatest(1, chunk * 200 - 49):chunk * 200 + 200], ' ') AS body FROM c""")
def chunk_200_50(spark, d):
    return text.word_chunks(table(spark, d, "documents"), "doc_id")


_THOUGHT = "'<think>' || substr(text, 1, 40) || '</think>' || text || '<think>x' || chr(10) || 'y</think>'"


@query(f"SELECT doc_id, regexp_replace({_THOUGHT}, '(?s)<think>.*?</think>', '', 'g') AS content FROM documents")
def strip_reasoning(spark, d):
    return table(spark, d, "documents").select("doc_id", text.without_reasoning(F.expr(_THOUGHT.replace("chr(10)", "'\\n'"))).alias("content"))


@query("""
SELECT d.doc_id, CASE WHEN length(text) > 5000 THEN 'length' WHEN l.toxic = 1 THEN 'self check' END AS reason, coalesce(length(text) > 5000 OR l.toxic = 1, false) AS blocked
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def guardrail_block(spark, d):
    return text.rail(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "toxic", 5000).select("doc_id", "reason", "blocked")


# ---------------------------------------------------------------- names, configuration, keys


@query("SELECT p_partkey, CASE WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END AS env_name FROM (SELECT p_partkey, regexp_replace(upper(p_size || p_name || '.' || p_brand), '[^A-Z0-9_]', '_', 'g') AS n FROM part)")
def env_name_safe(spark, d):
    s = F.concat(F.col("p_size").cast("string"), "p_name", F.lit("."), "p_brand")
    return table(spark, d, "part").select("p_partkey", S.env_name_safe(s).alias("env_name"))


@query("""
SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9]', '_', 'g') AS clean, replace(p_name || '+' || p_size, '+', '_') AS label,
  regexp_replace(substr(CASE WHEN contains(p_name, p_type) THEN p_name ELSE p_name || '-' || p_type END, 1, 63), '-$', '') AS release,
  concat_ws(',', CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '*' END, p_type) AS hosts FROM part""")
def template_names(spark, d):
    p = table(spark, d, "part")
    given = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return p.select(
        "p_partkey",
        S.sanitize(F.concat_ws(" ", "p_brand", "p_name")).alias("clean"),
        S.label_value(F.concat("p_name", F.lit("+"), F.col("p_size").cast("string"))).alias("label"),
        S.release_name(F.lit(None).cast("string"), F.col("p_type"), F.col("p_name")).alias("release"),
        S.allowed_hosts(given, F.lit("*"), F.col("p_type")).alias("hosts"),
    )


@query("""
SELECT p_partkey, ord, key, value FROM (SELECT p_partkey, unnest([0, 1, 2]) AS ord, unnest(['DOMAIN', 'ENDPOINT', 'MODEL']) AS key,
  unnest([p_name, 'https://' || p_brand || '.example/v1', upper(p_type || '_' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'))]) AS value FROM part)""")
def render_env(spark, d):
    p = table(spark, d, "part")
    entries = C.render({"DOMAIN": "{p_name}", "ENDPOINT": "https://{p_brand}.example/v1", "MODEL": "{p_type|upper}_{p_brand|sanitize|upper}"})
    return p.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(entries)])).alias("e")).select("p_partkey", "e.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN strftime(TIMESTAMP '2020-02-03 04:05:06' + to_microseconds(c_custkey * 250000), '%Y-%m-%dT%H:%M:%S') ELSE strftime(TIMESTAMP '2020-02-03 04:05:06' + to_microseconds(c_custkey * 250000), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS iso, CASE c_custkey % 3 WHEN 0 THEN '644' WHEN 1 THEN '755' ELSE '600' END AS mode FROM customer")
def time_and_mode(spark, d):
    ts = F.timestamp_micros(F.lit(1580702706000000) + F.col("c_custkey") * 250000)
    mode = F.get(F.array(F.lit(0o100644), F.lit(0o40755), F.lit(0o100600)), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", S.iso_time(ts).alias("iso"), S.permissions(mode).alias("mode"))


@query("SELECT event_id, substr(sha256(props), 1, 8) AS hash, substr(sha256('{\"event\": \"' || event_type || '\", \"user\": \"' || user_id || '\"}'), 1, 8) AS canonical FROM events")
def payload_hash8(spark, d):
    m = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.short_hash(F.col("props")).alias("hash"), keysync.keys_hash(m).alias("canonical"))


_CONFIGS = """SELECT CASE WHEN event_id % 5 = 0 THEN 'other-' ELSE 'deploymentconfig-' END || user_id AS name, event_id,
CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{"bad' WHEN 2 THEN '{"Namespace": "ns", "Name": "m", "ExternalEndpoint": {"ApiKey": ""}}'
ELSE '{"Namespace": "ns-' || event_type || '", "Name": "model.' || user_id % 20 || '", "ExternalEndpoint": {"ApiKey": "key' || event_id || '"}}' END AS deploymentConfig FROM events"""


def _configs(spark, d):
    table(spark, d, "events").createOrReplaceTempView("_tessera_events")
    return spark.sql(_CONFIGS.replace("FROM events", "FROM _tessera_events"))


_EXTRACTED = f"""
WITH c AS ({_CONFIGS}), g AS (SELECT *, CASE WHEN json_valid(deploymentConfig) THEN deploymentConfig END AS j FROM c WHERE regexp_matches(name, '^deploymentconfig-(.+)$')),
x AS (SELECT name, event_id, j ->> '$.Namespace' AS model_namespace, j ->> '$.Name' AS model, j ->> '$.ExternalEndpoint.ApiKey' AS api_key,
  CASE WHEN deploymentConfig IS NULL THEN 'missing' WHEN j IS NULL THEN 'bad JSON' WHEN coalesce(j ->> '$.ExternalEndpoint.ApiKey', '') = '' THEN 'missing' END AS problem FROM g),
e AS (SELECT *, regexp_replace(upper(model_namespace || '_' || model), '[^A-Z0-9_]', '_', 'g') AS env_name FROM x)"""


@query(_EXTRACTED + " SELECT event_id, name, api_key, env_name, problem FROM e")
def config_json_extract(spark, d):
    return keysync.extracted(_configs(spark, d)).select("event_id", "name", "api_key", "env_name", "problem")


@query(_EXTRACTED + " SELECT env_name, arg_max(api_key, event_id) AS api_key FROM e WHERE problem IS NULL GROUP BY env_name")
def key_last_wins(spark, d):
    return keysync.key_map(keysync.extracted(_configs(spark, d)).where("problem is null"), "env_name", "api_key", ["event_id"])


@query("""
WITH h AS (SELECT user_id, event_id, substr(sha256(props), 1, 8) AS hash, lag(substr(sha256(props), 1, 8)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT user_id, event_id, hash, hash IS DISTINCT FROM previous AS roll_out FROM h""")
def rollout_on_change(spark, d):
    return keysync.rollouts(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("props")).select("user_id", "event_id", "hash", "roll_out")


# ---------------------------------------------------------------- vectors


@query("""
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round((CAST(embedding[i] AS DOUBLE) / 255 - 0.5) / 0.5, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)""")
def pixel_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.normalized(F.col("embedding"))).alias("pos", "x"))
    return e.select("vec_id", "pos", F.round("x", 6).alias("x"))


@query("""
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(CAST(embedding[i % 4 * 16 + i // 4 + 1] AS DOUBLE), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)""")
def pixel_transpose(spark, d):
    px = vectors.channels_last(F.col("embedding"), F.lit(4), F.lit(4), 4)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(px).alias("pos", "x")).select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


_P = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS z FROM embeddings),
x AS (SELECT vec_id, label, z, list_transform(z, lambda x: exp(x - list_max(z))) AS q FROM e),
p AS (SELECT vec_id, label, list_position(z, list_max(z)) - 1 AS predicted, list_transform(q, lambda x: x / list_sum(q)) AS p FROM x)"""


def _predictions(spark, d):
    z = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10)
    e = table(spark, d, "embeddings").select("vec_id", "label", z.alias("z"))
    return e.select("vec_id", "label", vectors.softmax(F.col("z")).alias("p"), vectors.argmax(F.col("z")).alias("predicted"))


@query(_P + " SELECT vec_id, CAST(predicted AS INTEGER) AS predicted, round(list_max(p), 6) AS probability FROM p")
def softmax_argmax(spark, d):
    return _predictions(spark, d).select("vec_id", "predicted", F.round(F.array_max("p"), 6).alias("probability"))


@query(_P + " SELECT label, count(*) AS n, round(avg(-ln(p[label + 1])), 6) AS loss, round(avg(CAST(predicted = label AS INTEGER)), 6) AS accuracy FROM p GROUP BY label")
def loss_accuracy_by_label(spark, d):
    p = _predictions(spark, d)
    hit = (F.col("predicted") == F.col("label")).cast("int")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.cross_entropy(F.col("p"), F.col("label"))), 6).alias("loss"), F.round(F.avg(hit), 6).alias("accuracy"))


@query("""
WITH b AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 128 AS b, value FROM events), m AS (SELECT event_type, b, avg(value) AS m FROM b GROUP BY ALL)
SELECT event_type, count(*) AS n_batches, round(avg(m), 6) AS mean FROM m GROUP BY event_type""")
def mean_of_batch_means(spark, d):
    m = vectors.mean_of_batch_means(table(spark, d, "events"), "value", ["event_id"], 128, "event_type")
    return m.select("event_type", "n_batches", F.round("mean", 6).alias("mean"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id BETWEEN 10 AND 19")
def row_range(spark, d):
    return table(spark, d, "embeddings").where("vec_id between 10 and 19").select("vec_id", "label")


# ---------------------------------------------------------------- runs and models


@query("""
WITH b AS (SELECT user_id, event_id, value, greatest(0, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best_before FROM events)
SELECT user_id, event_id, round(best_before, 6) AS best_before, value > best_before AS is_best FROM b""")
def running_best(spark, d):
    r = registry.running_best(table(spark, d, "events"), "value", ["ts", "event_id"], ["user_id"])
    return r.select("user_id", "event_id", F.round("best_before", 6).alias("best_before"), "is_best")


def _runs(spark, d):
    o = table(spark, d, "orders")
    acc = F.when(F.col("o_orderkey") % 9 != 0, F.round(F.col("o_totalprice") / 1e6, 6))
    return o.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderpriority").alias("experiment_id"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("FAILED").alias("status"),
        F.create_map(F.lit("batch"), (F.col("o_custkey") % 7).cast("string")).alias("params"),
        F.when(acc.isNotNull(), F.create_map(F.lit("acc"), acc)).otherwise(F.create_map()).alias("metrics"),
    )


def _versions(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 3 <> 0")
    return o.select(F.lit("net").alias("name"), F.col("o_orderkey").cast("int").alias("version"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.when(F.col("o_custkey") % 3 == 1, "Production").alias("current_stage"))


_BEST = """
WITH b AS (SELECT 'r' || o_orderkey AS run_id, o_orderkey, o_custkey, round(o_totalprice / 1e6, 6) AS acc FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_orderkey % 9 <> 0 ORDER BY acc DESC, run_id LIMIT 20)"""


@query(_BEST + " SELECT run_id, acc FROM b")
def best_run_topk(spark, d):
    best = registry.search_runs(_runs(spark, d), "1-URGENT", "FINISHED", "acc", 20)
    return best.select("run_id", F.col("metrics")["acc"].alias("acc"))


@query(_BEST + """ SELECT run_id, CASE WHEN o_custkey % 3 = 1 THEN 'models:/net/Production' WHEN o_custkey % 3 = 2 THEN 'models:/net/' || o_orderkey ELSE 'runs:/' || run_id || '/model' END AS uri FROM b""")
def registry_model_uri(spark, d):
    best = registry.search_runs(_runs(spark, d), "1-URGENT", "FINISHED", "acc", 20)
    linked = registry.best_with_version(best.select("run_id"), _versions(spark, d), "net")
    return linked.select("run_id", registry.model_uri(F.lit("net"), F.col("current_stage"), F.col("version"), F.col("run_id")).alias("uri"))


@query("""
SELECT CAST(o_orderkey AS INTEGER) AS version, CASE WHEN o_orderkey = 4 THEN 'Production' WHEN o_custkey % 3 = 1 THEN 'Archived' END AS current_stage FROM orders WHERE o_custkey % 3 <> 0""")
def stage_transition(spark, d):
    v = _versions(spark, d)
    return registry.transition(v, "net", 4, "Production", archive_existing=True).select("version", "current_stage")


@query("SELECT 'r' || o_orderkey AS run_id FROM orders WHERE o_orderkey % 4 <> 0")
def delete_runs(spark, d):
    r = _runs(spark, d)
    return registry.delete_runs(r.select("run_id"), table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id")))


@query("""
SELECT user_id, arg_max(event_id, {'v': value, 's': -event_id}) AS best_step, max(value) AS best_value FROM events GROUP BY user_id""")
def best_by_key_first_tie(spark, d):
    return registry.best_by_key(table(spark, d, "events"), ["user_id"], "value", "event_id")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def object_exists(spark, d):
    return objects.existing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_refs(spark, d):
    return keysync.missing_refs(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'added' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def refs_completed(spark, d):
    have = table(spark, d, "labels").select("doc_id", F.lit("label").alias("origin"))
    return keysync.with_refs(have, keysync.missing_refs(table(spark, d, "documents").select("doc_id"), have, "doc_id").withColumn("origin", F.lit("added")))


# ---------------------------------------------------------------- agents

_CALLS = "text || chr(10) || 'TOOL_CALL: list_tables(schema=\"db' || turn || '\")' || chr(10) || 'TOOL_CALL: read_file(path=\"/a/' || conv_id || '\",' || chr(10) || ' head=3)'"


def _with_calls(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_CALLS.replace("chr(10)", "'\\n'")).alias("text"))


_TOOL_CALLS = f"""
WITH t AS (SELECT conv_id, turn, {_CALLS} AS text FROM conversations), m AS (SELECT conv_id, turn, regexp_extract_all(text, '(?s)TOOL_CALL:\\s*(\\w+)\\((.*?)\\)', 1) AS n, regexp_extract_all(text, '(?s)TOOL_CALL:\\s*(\\w+)\\((.*?)\\)', 2) AS a FROM t),
c AS (SELECT conv_id, turn, CAST(unnest(range(0, len(n))) AS INTEGER) AS pos, unnest(n) AS name, trim(unnest(a)) AS args_text FROM m)"""


@query(_TOOL_CALLS + " SELECT conv_id, turn, pos, name, args_text FROM c")
def tool_calls(spark, d):
    return agents.tool_calls(_with_calls(spark, d), ["conv_id", "turn"])


@query(_TOOL_CALLS + " SELECT conv_id, turn, pos, name, CASE name WHEN 'list_tables' THEN 'Lists the tables of a schema' ELSE name || ' not found' END AS result FROM c")
def tool_dispatch(spark, d):
    first = spark.sql("SELECT * FROM VALUES ('list_tables', 'Lists the tables of a schema', 0) AS t(name, description, ord)")
    second = spark.sql("SELECT * FROM VALUES ('list_tables', 'Another of the same name', 0), ('execute_query', 'Runs SQL', 1) AS t(name, description, ord)")
    return agents.dispatched(agents.tool_calls(_with_calls(spark, d), ["conv_id", "turn"]), agents.registry_of([first, second])).select("conv_id", "turn", "pos", "name", "result")


@query(_TOOL_CALLS + """, k AS (SELECT conv_id, turn, pos, unnest(CASE pos WHEN 0 THEN ['schema'] ELSE ['path', 'head'] END) AS key, unnest(CASE pos WHEN 0 THEN ['db' || turn] ELSE ['/a/' || conv_id, '3'] END) AS value FROM c)
SELECT conv_id, turn, pos, key, value FROM k""")
def tool_arguments(spark, d):
    return agents.parsed_calls(_with_calls(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", "pos", F.explode("args").alias("key", "value"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), h AS (SELECT * FROM r WHERE r <= 3)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM h""")
def history_last3(spark, d):
    return agents.history(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "place")


@query("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def merge_messages(spark, d):
    return agents.merged_messages(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"])


@query("SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS listing FROM conversations GROUP BY conv_id")
def role_listing(spark, d):
    c = table(spark, d, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    return agents.listing(c, ["conv_id"], "line", ["turn"])


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 2 = 0 THEN 'sql' WHEN role = 'user' THEN 'research' WHEN role = 'assistant' THEN 'summary' ELSE 'END' END AS next FROM conversations")
def route_next(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("state"), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("cond"))
    edges = spark.sql("SELECT * FROM VALUES ('user', 'even', 'sql'), ('user', NULL, 'research'), ('assistant', NULL, 'summary') AS t(src, cond, dst)")
    return agents.routed(c, edges).select("conv_id", "turn", "next")


@query("""
SELECT 'tool' || p_partkey AS name, CASE WHEN p_size % 4 = 0 THEN 'tool' || p_partkey || ': ' || p_name || chr(10)
  ELSE 'tool' || p_partkey || '(' || chr(10) || '  path: string (required)' || chr(10) || '  size: ' || CASE p_size % 4 WHEN 1 THEN 'integer' ELSE 'unknown' END || chr(10) || ')' || chr(10) || 'Description: ' || p_name || chr(10) END AS text FROM part""")
def tool_schema_text(spark, d):
    """A tool of each part: its arguments, types and whether they are required, as text; some have no schema."""
    kind = F.when(F.col("p_size") % 4 == 1, '{"type": "integer"}').otherwise("{}")
    schema = F.concat(F.lit('{"properties": {"path": {"type": "string"}, "size": '), kind, F.lit('}, "required": ["path"]}'))
    t = table(spark, d, "part").select(F.concat(F.lit("tool"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("description"), F.when(F.col("p_size") % 4 != 0, schema).alias("schema"))
    return agents.schema_text(t)


@query("SELECT l.doc_id, string_split(text, chr(10))[1] AS line FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1")
def federated_lookup(spark, d):
    return federated.first_lines(table(spark, d, "labels").where("quality = 1"), table(spark, d, "documents"), "doc_id")


@query("""
WITH f AS (SELECT * FROM (VALUES ('David', 'Silver', 'A105'), ('John', 'Gold', 'A105'), ('Tiffany', 'Silver', 'C103'), ('Greg', 'Platinum', 'A105')) AS t(Name, Status, Flight)),
b AS (SELECT * FROM (VALUES ('Silver members enjoy early boarding.'), ('Gold members enjoy early boarding and priority seating.'), ('Platinum members enjoy early boarding, priority seating, and free flights.')) AS t(value))
SELECT Name, Status, value FROM f LEFT JOIN b ON string_split(value, ' ')[1] = Status WHERE Flight = 'A105'""")
def status_benefits(spark, d):
    f = spark.sql("SELECT * FROM VALUES ('David', 'Silver', 'A105'), ('John', 'Gold', 'A105'), ('Tiffany', 'Silver', 'C103'), ('Greg', 'Platinum', 'A105') AS t(Name, Status, Flight)")
    b = spark.sql("SELECT * FROM VALUES ('Silver members enjoy early boarding.'), ('Gold members enjoy early boarding and priority seating.'), ('Platinum members enjoy early boarding, priority seating, and free flights.') AS t(value)")
    return federated.status_lines(f.where("Flight = 'A105'"), b, "Status").select("Name", "Status", "value")


# ---------------------------------------------------------------- plain SQL, as Spark offers it

_SAME: dict[str, str] = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_six_tables": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_set_operations": "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 0 INTERSECT SELECT s_nationkey FROM supplier)",
    "sql_correlated": "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "sql_semi_anti": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "sql_windows": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders",
    "sql_theta_join": "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
}


def _plain(name: str, statement: str):
    def run(spark, d):
        register(spark, d)
        return sql.execute_query(spark, statement + ";")

    run.__name__ = name
    query(statement)(run)


for _name, _statement in _SAME.items():
    _plain(_name, _statement)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    t = tumbling(table(spark, d, "events"))
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(CAST(k AS BIGINT) * 6) AS start, value FROM events, range(0, 4) r(k))
SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY start""")
def sql_sliding(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("window.start").alias("start"), "n", "total")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def sql_sessions(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("""
SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def sql_asof(spark, d):
    """The last view before each purchase, by one pass over each user's events in time."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'view')")
    w = W.partitionBy("user_id").orderBy("ts", F.desc("event_type")).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select("event_id", "view_id")


@query("SELECT event_type, true AS close FROM events GROUP BY event_type")
def sql_approximate(spark, d):
    """The estimate is over each user once, which leaves it as it is: beside a distinct count over all rows Spark would hold
    a sketch for each type and user."""
    each = table(spark, d, "events").select("event_type", "user_id").distinct()
    e = each.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count("user_id").alias("b"))
    return e.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("close"))


@query("SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) AS t(col_name, data_type)")
def sql_table_schema(spark, d):
    register(spark, d, ["region"])
    return sql.get_table_schema(spark, "region").select("col_name", "data_type")


@query("SELECT unnest(['nation', 'region']) AS name")
def sql_list_tables(spark, d):
    register(spark, d, ["nation", "region"])
    return sql.list_tables(spark).where("tableName in ('nation', 'region')").select(F.col("tableName").alias("name"))


# ---------------------------------------------------------------- samples, batches, prompts, policies


@query("SELECT vec_id, label FROM embeddings WHERE vec_id < 25")
def first_samples(spark, d):
    return vectors.first_samples(table(spark, d, "embeddings"), "vec_id", 25).select("vec_id", "label")


@query("SELECT vec_id // 128 AS batch_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM embeddings GROUP BY 1")
def batches_of_128(spark, d):
    return vectors.batched(table(spark, d, "embeddings"), "vec_id").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


@query("SELECT vec_id, list_max(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000, 0) AS INTEGER))) > 128 AS prepare FROM embeddings")
def pixel_range(spark, d):
    px = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000, 0).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", vectors.needs_preparing(px).alias("prepare"))


@query("SELECT conv_id, turn, role || ' said in turn ' || turn || ': ' || text AS prompt FROM conversations")
def prompt_text(spark, d):
    c = table(spark, d, "conversations")
    p = agents.prompt("{who} said in turn {n}: {what}", who=F.col("role"), n=F.col("turn"), what=F.col("text"))
    return c.select("conv_id", "turn", p.alias("prompt"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 IN (0, 1) AND event_id % 2 = 0")
def policy_match(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 3).cast("string").alias("namespace"), F.when(F.col("event_id") % 2 == 0, "CREATE").otherwise("DELETE").alias("operation"))
    return agents.policy_match(e, ["click", "view"], ["0", "1"], ["CREATE", "UPDATE"]).select("event_id")


@query("SELECT p_partkey, p_name AS name FROM part WHERE p_name NOT IN ('small ring', 'red widget')")
def tool_filter(spark, d):
    return agents.chosen_tools(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), ["small ring", "red widget"], leave_out=True)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || o_orderpriority || '_bs' || o_custkey || '_lr0.001' AS run_name FROM orders")
def run_names(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.run_name(F.col("o_orderdate"), F.col("o_orderpriority"), F.col("o_custkey"), F.lit("0.001")).alias("run_name"))


@query("SELECT c_custkey, format('{:,}', c_custkey * 12345) AS grouped, round(c_custkey * 123456789 / 1073741824.0::DOUBLE, 2) AS gib, printf('%.4f', c_acctbal) AS fixed FROM customer")
def format_numbers(spark, d):
    n = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", S.thousands(n * 12345).alias("grouped"), S.gib(n * 123456789).alias("gib"), F.format_string("%.4f", "c_acctbal").alias("fixed"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'Error: code ' || user_id ELSE CAST(event_id AS VARCHAR) END AS result FROM events")
def coerced_results(spark, d):
    e = F.when(F.col("event_type") == "error", F.concat(F.lit("code "), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", S.coerced(F.col("event_id"), e).alias("result"))
