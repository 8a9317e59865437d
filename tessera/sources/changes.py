"""A feed of configuration changes as a streaming source: first a snapshot, then versions, from any offset on.

A feed is a folder with a log (``log.Log``) and Parquet files. ``publish`` appends versions of changes, ``compact`` a
snapshot of the state at a version, ``expire`` removes versions that a snapshot covers. ``format("changes")`` streams it:
an offset is the last version delivered. A reader from the start gets the newest snapshot and what came after; one that has
been away so long that versions it needs are gone is told to start over, by a RESET row ahead of the newest snapshot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .log import Conflict, Log, files_below
from .versioned import VersionedTable

#: What a reader gets. op is SNAPSHOT (state at a version), UPSERT, DELETE, or RESET, whose key is null; ord is the place in a version.
FEED = "version long, ord long, op string, key string, value string"
#: Bytes of files that one task of a batch reads, if a file isn't larger.
SHARE = 64 << 20


def folded(path: str) -> dict:
    """What a feed's log adds up to: ``snapshots`` {version: folder}, ``versions`` {version: folder}, last, and expired, the
    version up to which changes are gone."""
    log, state = Log(f"{path}/_log"), {"snapshots": {}, "versions": {}, "last": -1, "expired": -1, "entries": 0}
    for n in log.numbers():
        e = log.read(n)
        state["entries"] = n + 1
        if e["kind"] == "changes":
            state["versions"] |= {v: f"{e['folder']}/version={v}" for v in e["versions"]}
            state["last"] = max(state["last"], *e["versions"])
        elif e["kind"] == "snapshot":
            state["snapshots"][e["version"]] = e["folder"]
        else:
            state["expired"] = max(state["expired"], e["version"])
            state["versions"] = {v: f for v, f in state["versions"].items() if v > state["expired"]}
    return state


def _append(path: str, make, attempts: int = 20) -> None:
    """Append the entry that make(state) gives for the feed as it is when it is appended."""
    for _ in range(attempts):
        state = folded(path)
        if Log(f"{path}/_log").append(state["entries"], make(state)):
            return
    raise Conflict(f"the log of {path} is too busy")


def publish(changes: DataFrame, path: str) -> None:
    """Append changes (version, ord, op, key, value) to a feed; rows of one version become visible together, and versions in
    one call too. They must be above all that are there. value is text, JSON for objects; op is UPSERT or DELETE."""
    folder = f"data/{uuid.uuid4().hex}"
    rows = changes.select(*[F.col(c).cast(t).alias(c) for c, t in (f.split() for f in FEED.split(", "))])
    rows.repartition("version").sortWithinPartitions("version", "ord").write.partitionBy("version").parquet(f"{path}/{folder}")
    versions = sorted(r[0] for r in changes.sparkSession.read.parquet(f"{path}/{folder}").select("version").distinct().collect())

    def entry(state):
        if versions[0] <= state["last"]:
            raise ValueError(f"version {versions[0]} isn't above {state['last']}")
        return {"kind": "changes", "folder": folder, "versions": versions}

    if versions:
        _append(path, entry)


def state_at(spark: SparkSession, path: str, version: int) -> DataFrame:
    """(key, value, version) of the keys that are there at a version: the last change of each, over the newest snapshot."""
    feed = folded(path)
    base = max((v for v in feed["snapshots"] if v <= version), default=-1)
    if version < feed["expired"] and base < 0:
        raise ValueError(f"version {version} is gone")
    known = spark.createDataFrame([], "version long, ord long, op string, key string, value string")
    if base >= 0:
        kept = spark.read.parquet(f"{path}/{feed['snapshots'][base]}")
        known = kept.select("version", F.lit(-1).cast("long").alias("ord"), F.lit("UPSERT").alias("op"), "key", "value")
    later = [f"{path}/{f}" for v, f in feed["versions"].items() if base < v <= version]
    if later:
        # The folder's name tells the version; it is a column of its own only below their common root.
        some = spark.read.parquet(*later).withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "version=([0-9]+)/", 1).cast("long"))
        known = known.unionByName(some.select(*known.columns))
    return known.groupBy("key").agg(F.max_by(F.struct("op", "value", "version"), F.struct("version", "ord", "op", "value")).alias("v")).where("v.op <> 'DELETE'").select("key", "v.value", "v.version")


def compact(spark: SparkSession, path: str, version: int) -> None:
    """Write the state at a version as a snapshot; only a snapshot between the last one and the last version is of use."""
    folder = f"data/{uuid.uuid4().hex}"
    state_at(spark, path, version).write.parquet(f"{path}/{folder}")
    _append(path, lambda _: {"kind": "snapshot", "version": version, "folder": folder})


def expire(path: str, version: int) -> None:
    """Let go of all changes up to a version, which a snapshot must cover. Readers further behind start over."""

    def entry(state):
        if max(state["snapshots"], default=-1) < version:
            raise ValueError(f"no snapshot covers version {version}")
        return {"kind": "expired", "version": version}

    gone = {v: f for v, f in folded(path)["versions"].items() if v <= version}
    _append(path, entry)
    from .log import file_system

    fs, at = file_system(path)
    for folder in gone.values():
        fs.delete_dir(f"{at}/{folder}")


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, str]]):
        self.files = files


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        return {"version": folded(self.path)["last"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Files of a few megabytes each are read together; a snapshot is read where the reader is at the start, or where
        what it lacks has expired."""
        feed, after = folded(self.path), start["version"]
        parts: list[InputPartition] = []
        base = max((v for v in feed["snapshots"] if after < v <= end["version"]), default=None)
        wanted: list[tuple[str, int, str]] = []
        if base is not None and (after < 0 or after < feed["expired"]):
            if after >= 0:
                parts.append(_Files([("", base, "RESET")]))
            wanted += [(feed["snapshots"][base], base, "SNAPSHOT")]
            after = base
        elif after < min(feed["expired"], end["version"]):
            raise ValueError(f"changes from {after + 1} on have expired without a snapshot up to {end['version']}")
        wanted += [(f, v, "") for v, f in sorted(feed["versions"].items()) if after < v <= end["version"]]
        some, size = [], 0
        for folder, version, op in wanted:
            for file, n in files_below(f"{self.path}/{folder}", ".parquet"):
                some.append((file, version, op))
                size += n
                if size >= SHARE:
                    parts.append(_Files(some))
                    some, size = [], 0
        return parts + ([_Files(some)] if some or not parts else [])

    def read(self, partition: _Files):
        import pyarrow as pa
        import pyarrow.parquet as pq

        from .log import file_system

        kinds = pa.schema([("version", pa.int64()), ("ord", pa.int64()), ("op", pa.string()), ("key", pa.string()), ("value", pa.string())])
        fs, _ = file_system(self.path)
        for file, version, op in partition.files:
            if not file:
                yield pa.RecordBatch.from_pylist([{"version": version, "ord": -1, "op": op}], schema=kinds)
                continue
            with pq.ParquetFile(file, filesystem=fs) as f:
                for b in f.iter_batches(batch_size=10_000, columns=["key", "value"] if op else ["ord", "op", "key", "value"]):
                    n = len(b)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([version] * n, pa.int64()),
                            pa.array([0] * n, pa.int64()) if op else b.column("ord"),
                            pa.array([op] * n, pa.string()) if op else b.column("op"),
                            b.column("key").cast(pa.string()),
                            b.column("value").cast(pa.string()),
                        ],
                        schema=kinds,
                    )

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ChangesSource(DataSource):
    """format("changes"): option path. The path must be one that driver and executors reach by ``log.file_system``."""

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def change_stream(spark: SparkSession, path: str) -> DataFrame:
    """The feed as a stream of FEED rows. Each trigger takes all versions there are; a batch that is run again after a
    failure has the same offsets."""
    spark.dataSource.register(ChangesSource)
    return spark.readStream.format("changes").option("path", path).load()


def follow(stream: DataFrame, target: VersionedTable, checkpoint: str, **trigger):
    """Keep a table of versions (key, value) in step with a stream of changes: one version a batch, each batch once.

    The batch's number is noted with the version that it made, so one that is run again after its version was written
    changes nothing. After a RESET the table holds what the snapshot holds and what changed after it, and nothing else."""

    def apply(batch: DataFrame, number: int) -> None:
        if target.note().get("batch", -1) >= number:
            return
        rows = batch.where("key is not null").withColumns({"place": F.struct("version", "ord"), "gone": F.col("op") == "DELETE"})
        if batch.where("op = 'RESET'").isEmpty():
            target.merge(rows.select("key", "value", "place", "gone"), order="place", delete="gone", note={"batch": number})
            return
        last = rows.groupBy("key").agg(F.max_by(F.struct("value", "gone"), F.struct("place", "value")).alias("v")).where("not v.gone").select("key", "v.value")
        target.transact(lambda now: now.where("false").unionByName(last), note={"batch": number})

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()
