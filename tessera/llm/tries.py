"""Prefix tries over conversations.

A turn becomes a unit of 20 bytes, the digest of its role and text and its number of words, and a conversation the path of
its units; texts never leave the first stage. Equal paths become one weighted row before any trie is built. Paths are
dealt out by the digest of their first turn, and each deal builds tries of pointer dictionaries inside ``applyInPandas``,
summed up in postorder without recursion. A first turn with more turns below it than a task should hold isn't built:
its paths are followed to where they part and become subtries by their next turn, and so on; the nodes above are sums over
those subtries' tops.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship, stored

#: Bytes of a unit; of them those of the digest.
UNIT, DIGEST = 20, 16
#: Turns that a subtrie may hold at most, and at least before it is parted; bits of an id that one piece of a list of ids
#: spans; rows of a table that is broadcast.
LARGEST, LEAST, PIECE_BITS, SMALL = 200_000, 256, 10, 50_000
NOTHING = hashlib.sha256(b"").hexdigest()
#: How many conversations share a first one, whose opening turns they take over; and how many turns at most, less one.
FAMILY, OPENINGS = 20, 4

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE = [x.split(" ")[0] for x in _NODE.split(", ")]


def turn_units(turns: DataFrame) -> DataFrame:
    """(family, conv_id, units) of each conversation of turns (conv_id, turn, role, text), in the order of turn, null first.

    Null role and text are empty. Turns of the same number come in the order of their digests, repeated rows are turns of
    their own. Rows without a conv_id belong to no conversation and are left out. A conversation's units are one row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    unit = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.hex(words.cast("long")), 2 * (UNIT - DIGEST), "0"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), unit.alias("unit")).where(F.col("conv_id").isNotNull())
    rows = rows.withColumn("family", F.expr(f"conv_id - conv_id % {FAMILY}"))
    # One shuffle: a family's conversations stay together.
    in_order = F.sort_array(F.collect_list(F.struct("turn", "unit")))
    return rows.repartition("family").groupBy("family", "conv_id").agg(F.transform(in_order, lambda x: x["unit"]).alias("units"))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): conversations with their first h turns taken from the first of their family, conv_id - conv_id % 20.

    h is the CRC-32 of the decimal conv_id modulo 4. Where the family has no such conversation none are taken, where it has
    fewer turns all. Of negative ids the remainder is negative, as in SQL."""
    each = turn_units(turns).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int"))
    opening = F.first(F.when(F.col("conv_id") == F.col("family"), F.slice("units", 1, OPENINGS - 1)), ignorenulls=True).over(Window.partitionBy("family"))
    each = each.withColumn("opening", opening)
    path = F.expr("concat(slice(coalesce(opening, cast(array() as array<string>)), 1, h), slice(units, h + 1, greatest(size(units) - h, 0)))")
    return each.select("conv_id", F.unhex(F.array_join(path, "")).alias("path"))


def weighted(paths: DataFrame) -> DataFrame:
    """One row for each distinct path: path, turns, n (conversations), least (the smallest id), ends_sha256 of their ids.

    Ids are joined in pieces of neighbouring ids and hashed as sorted pieces stream by, so no list of all ids of a path is
    ever held, however many conversations are alike."""
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = paths.groupBy(F.md5("path").alias("of"), F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids.alias("ids"), F.first("path").alias("path"))
    pieces = pieces.select("of", "piece", "path", F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches):
        import pyarrow as pa

        names = ["path", "turns", "n", "least", "ends_sha256"]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        now, done = None, []

        def closed():
            of, path, n, least, sha = now
            done.append((path, len(path) // UNIT, n, least, sha.hexdigest()))

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names)
            done.clear()
            return out

        for b in batches:
            for of, path, least, n, joined in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if now and now[0] == of:
                    now[2] += n
                    now[4].update(b"," + joined.encode())
                    continue
                if now:
                    closed()
                now = [of, path, n, least, hashlib.sha256(joined.encode())]
            if len(done) >= 1000:
                yield batch()
        if now:
            closed()
        if done:
            yield batch()

    return map_arrow(pieces.repartition("of").sortWithinPartitions("of", "piece"), run, "path binary, turns long, n long, least long, ends_sha256 string")


def build(pdf):
    """The nodes of all subtries of one deal, from rows (key, depth, path, n, least, ends_sha256, parent_conv, split).

    Rows of one key share their path down to depth, where their subtrie's top is. split is kept with tops alone."""
    import pandas as pd

    tops: dict[str, int] = {}
    below: list[dict[bytes, int]] = []
    up, depth, n, least, words, ends, parent, split = [], [], [], [], [], [], [], []

    def node(of: int, at: int, unit: bytes) -> int:
        for column, value in ((below, {}), (up, of), (depth, at), (n, 0), (least, None), (words, int.from_bytes(unit[DIGEST:], "big")), (ends, NOTHING), (parent, None), (split, None)):
            column.append(value)
        return len(up) - 1

    for key, top, path, count, first, sha, above, of in zip(*(pdf[c].tolist() for c in ("key", "depth", "path", "n", "least", "ends_sha256", "parent_conv", "split"))):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(-1, top, path[UNIT * (top - 1) : UNIT * top])
            parent[at], split[at] = above, of
        n[at] += count
        least[at] = first if least[at] is None else min(first, least[at])
        for d in range(top, len(path) // UNIT):
            unit = path[UNIT * d : UNIT * (d + 1)]
            to = below[at].get(unit)
            if to is None:
                to = below[at][unit] = node(at, d + 1, unit)
            at = to
            n[at] += count
            least[at] = first if least[at] is None else min(first, least[at])
        ends[at] = sha
    # Children are numbered behind their parents, so backwards every node comes after all below it.
    leaves, saved = [0] * len(up), [(a - 1) * w for a, w in zip(n, words)]
    for i in range(len(up) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
            parent[i] = least[up[i]]
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": parent, "n_convs": n, "n_children": [len(x) for x in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "split": split})


def _common(hot: DataFrame) -> DataFrame:
    """hot with ``parts``: the depth down to which all paths between lo and hi agree."""
    names = hot.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            parts = []
            for lo, hi in zip(b.column(names.index("lo")).to_pylist(), b.column(names.index("hi")).to_pylist()):
                size = min(len(lo), len(hi))
                apart = np.flatnonzero(np.frombuffer(lo, np.uint8, size) != np.frombuffer(hi, np.uint8, size))
                parts.append(int(apart[0] if len(apart) else size) // UNIT)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int64())], [*names, "parts"])

    return map_arrow(hot, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hot.schema) + ", parts long")


def _chains(parted: DataFrame) -> DataFrame:
    """The nodes from the top of each parted subtrie down to where its paths part; all have the same members."""
    want = ["lo", "depth", "parts", "n", "least", "parent_conv", "split", "children", "leaves", "saved", "ends_sha256"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, depth, parts, n, least, parent, split, children, leaves, saved, ends in zip(*(b.column(i).to_pylist() for i in range(len(want)))):
                words = np.frombuffer(lo, ">u4")[UNIT // 4 - 1 :: UNIT // 4][depth - 1 : parts].astype(np.int64)
                below = saved + (n - 1) * np.cumsum(words[::-1])[::-1]
                m = len(words)
                # At most as many nodes in a batch as Arrow batches have rows elsewhere.
                for a in range(0, m, 10_000):
                    z = min(m, a + 10_000)
                    top, last, same = a == 0, z == m, z - a
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([least] * same, pa.int64()),
                            pa.array(np.arange(depth + a, depth + z)),
                            pa.array(([parent] if top else [least]) + [least] * (same - 1), pa.int64()),
                            pa.array([n] * same, pa.int64()),
                            pa.array([1] * (same - 1) + [children if last else 1], pa.int64()),
                            pa.array([leaves] * same, pa.int64()),
                            pa.array(below[a:z]),
                            pa.array([NOTHING] * (same - 1) + [ends if last else NOTHING], pa.string()),
                            pa.array(([split] if top else [None]) + [None] * (same - 1), pa.string()),
                        ],
                        [*NODE, "split"],
                    )

    return map_arrow(parted.select(*want), run, f"{_NODE}, split string")


def prefix_nodes(paths: DataFrame, largest: int = LARGEST) -> DataFrame:
    """One row for each distinct prefix of the paths (conv_id, path): the columns NODE, see ``prefix_trie``.

    A subtrie of more than ``largest`` turns, or of twice an even share of all turns and LEAST, isn't built in one task but
    parted at the first place where its paths differ. Each round of that reads only the paths still too many; a path that
    has no company any more ends its round."""
    spark = paths.sparkSession
    seqs = stored(weighted(paths))
    rows, turns, root_least, convs = seqs.agg(F.count("*"), F.sum("turns"), F.min("least"), F.sum("n")).first()
    deals = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(turns or 0) // largest))
    most = min(largest, max(LEAST, 2 * (turns or 0) // deals))

    def keyed(df: DataFrame, depth: str, parent: str, split: str) -> DataFrame:
        df = df.withColumns({"depth": F.expr(f"cast({depth} as int)"), "parent_conv": F.expr(f"cast({parent} as bigint)"), "split": F.expr(split)})
        return df.select("path", "turns", "n", "least", "ends_sha256", "depth", "parent_conv", "split", F.expr(f"md5(substring(path, 1, {UNIT} * depth))").alias("key"))

    closed, parted = [], []
    live = keyed(seqs.where("turns > 0"), "1", str(root_least) if root_least is not None else "null", "''")
    while True:
        sizes = live.groupBy("key").agg(
            F.sum(F.col("turns") - F.col("depth") + 1).alias("size"), F.first("split").alias("split"), F.first("depth").alias("depth"), F.first("parent_conv").alias("parent_conv"),
            F.sum("n").alias("n"), F.min("least").alias("least"), F.min("path").alias("lo"), F.max("path").alias("hi"),
        )
        hot = stored(_common(sizes.where(F.col("size") > most)))
        n_hot = hot.count()
        if not n_hot:
            closed.append(live)
            break
        names = hot.select("key", "parts", F.col("least").alias("above"))
        names = F.broadcast(names) if n_hot <= SMALL else names
        closed.append(live.join(names, "key", "left_anti"))
        inside = live.drop("parent_conv").join(names, "key")
        ended = inside.where(F.col("turns") == F.col("parts")).select("key", "ends_sha256")
        parted.append((hot, ended))
        live = stored(keyed(inside.where(F.col("turns") > F.col("parts")).withColumnRenamed("key", "from_key"), "parts + 1", "above", "from_key"))

    ship(spark)
    every = closed[0]
    for df in closed[1:]:
        every = every.unionByName(df)
    dealt = every.drop("turns").withColumn("deal", F.expr(f"pmod(xxhash64(key), {deals})"))
    nodes = stored(dealt.groupBy("deal").applyInPandas(build, f"{_NODE}, split string"))
    # Upwards: what the subtries below a parted one add up to, the last parted first.
    tops = nodes.where(F.col("split").isNotNull()).select("split", "n_leaves", "saved_tokens")

    def added(tops: DataFrame) -> DataFrame:
        return tops.groupBy("split").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))

    for hot, ended in reversed(parted):
        below = added(tops).withColumnRenamed("split", "key")
        whole = hot.join(below, "key", "left").join(ended, "key", "left")
        whole = whole.withColumns({"children": F.coalesce("children", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))})
        chain = stored(_chains(whole))
        nodes = nodes.unionByName(chain)
        tops = tops.unionByName(chain.where(F.col("split").isNotNull()).select("split", "n_leaves", "saved_tokens"))
    nodes = nodes.select(*NODE)
    if not rows:
        return nodes
    # The root sums up its children; a conversation without turns ends there.
    children = tops.where("split = ''").select(F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
    bare = seqs.where("turns = 0").select(F.lit(0).alias("child"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.col("ends_sha256").alias("ends"))
    sums = children.unionByName(bare).agg(F.sum("child").alias("n_children"), F.greatest(F.lit(1), F.sum("n_leaves")).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.coalesce(F.max("ends"), F.lit(NOTHING)).alias("ends_sha256"))
    root = sums.withColumns({"conv_id": F.lit(root_least).cast("long"), "depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(convs).cast("long")}).select(*NODE)
    return nodes.unionByName(root)


def prefix_trie(turns: DataFrame, largest: int = LARGEST) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations (``rebuilt_paths``), its root included.

    A node is a distinct sequence of the first ``depth`` turns, by role and text; its members are the conversations that
    start with it. conv_id: the smallest member. parent_conv_id: that of the parent, null for the root. n_convs: members.
    n_children: children. n_leaves: childless nodes of its subtree, itself included. saved_tokens: what its subtree saves if
    every prefix is kept once, in words. ends_sha256: of the decimal ids of the members that end here, in order, joined by
    commas. Null and empty texts and roles are the same turn; other columns are ignored; a table without conversations gives
    no rows, one whose conversations are without turns the root alone. How turns of one number, repeated rows and rows
    without a conv_id count is said at ``turn_units``.

    Turns of equal role and text are told by 128 bits of MD5. A conversation is one row of 40 bytes a turn while it is put
    together, so one of up to 50 million turns can be held; nothing else grows with a single key."""
    return prefix_nodes(rebuilt_paths(turns), largest)


#: CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS u FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(u ORDER BY turn NULLS FIRST, u) AS us FROM t GROUP BY conv_id),
r AS (SELECT own.conv_id, list_concat(list_slice(coalesce(b.us, []), 1, h), list_slice(own.us, h + 1, len(own.us))) AS us
      FROM (SELECT *, {_CRC.format("conv_id::VARCHAR")} % 4 AS h FROM own) own LEFT JOIN own b ON b.conv_id = own.conv_id - own.conv_id % 20),
p AS (SELECT conv_id, d, list_slice(us, 1, d) AS pre, d = len(us) AS last FROM (SELECT *, unnest(range(0, len(us) + 1)) AS d FROM r)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends FROM p GROUP BY pre, d),
k AS (SELECT list_slice(pre, 1, d - 1) AS up, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * len(regexp_extract_all(n.pre[n.d].text, '[^\x20\x09-\x0D]+')) END AS saves FROM n LEFT JOIN k ON k.up = n.pre AND k.d = n.d),
s AS (SELECT list_slice(pre, 1, a) AS pre, a AS d, sum(saves) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM x) GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, x.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN s ON s.pre = x.pre AND s.d = x.d LEFT JOIN x up ON up.d = x.d - 1 AND up.pre = list_slice(x.pre, 1, x.d - 1)
"""
