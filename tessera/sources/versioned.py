"""Tables of versions: conditional writes in the order they were made, and writers of which only one can be first.

A version is an entry of a log that names the files of each bucket of keys. A write makes new files for the buckets that it
touches and then tries to append the next entry; whoever comes second finds the entry there and starts again from it, or
loses. Readers see whole versions, old ones as long as their files are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .log import Conflict, Log

#: What a write of a row came to; None is done.
FAILED = "PRECONDITION_FAILED"


def judged(writes: DataFrame, present: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """(key, ord, etag, code, found) of each write (key, ord, if_match, etag, code): each is judged by the etag that the
    writes before it have left, found, null where there is nothing. present has key and etag, one row a key.

    A write with a code is refused for that reason and changes nothing. if_match null or empty asks for nothing; else it must
    be the etag found. A null etag is a delete. Writes of the same ord are taken by etag, nulls first. Rows of a key stream
    through one task in order, none of them held, and contents aren't among them."""
    w = writes.select(F.col(key).alias("key"), F.lit(1).alias("kind"), F.col(order).alias("sort"), "if_match", "etag", F.col("code").cast("string").alias("code"))
    sort = w.schema["sort"].dataType
    touched = present.select(F.col(key).alias("key"), "etag").join(w.select("key").distinct(), "key", "left_semi")
    p = touched.select("key", F.lit(0).alias("kind"), F.lit(None).cast(sort).alias("sort"), F.lit(None).cast("string").alias("if_match"), "etag", F.lit(None).cast("string").alias("code"))
    kind = writes.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        key_now, etag = None, None
        first = True
        for b in batches:
            keys, kinds, matches, etags, codes = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            said, found, rows = [], [], []
            for i, k in enumerate(keys):
                if first or k != key_now:
                    key_now, etag, first = k, None, False
                if not kinds[i]:
                    etag = etags[i]
                    continue
                code = codes[i] or (FAILED if matches[i] and matches[i] != etag else None)
                rows.append(i)
                said.append(code)
                found.append(etag)
                if code is None:
                    etag = etags[i]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), b.column(4).take(at), pa.array(said, pa.string()), pa.array(found, pa.string())], ["key", "ord", "etag", "code", "found"])

    every = w.unionByName(p).repartition("key").sortWithinPartitions("key", "kind", "sort", "etag")
    return every.select("key", "kind", "sort", "if_match", "etag", "code").mapInArrow(run, f"key {kind}, ord {sort.simpleString()}, etag string, code string, found string").select(F.col("key").alias(key), F.col("ord").alias(order), "etag", "code", "found")


def lasting(writes: DataFrame, said: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """Of each key's writes that were done the last one, as ``judged`` has said; writes that agree in key, order and etag
    are the same one."""
    done = said.where("code is null").groupBy(key).agg(F.max(F.struct(F.col(order), "etag")).alias("_last")).withColumnRenamed(key, "_key")
    here = (F.col(key) == F.col("_key")) & F.col(f"_last.{order}").eqNullSafe(F.col(order)) & F.col("_last.etag").eqNullSafe(F.col("etag"))
    return writes.where("code is null").join(done, here).drop("_key", "_last").dropDuplicates([key])


class VersionedTable:
    """A table with a key column, in a folder. Rows without a key can't be written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(f"{self.path}/_log")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64) -> VersionedTable:
        """An empty table as version 0; one that is there already stays as it is."""
        t = cls(spark, path)
        kind = spark.createDataFrame([], schema).schema
        t.log.append(0, {"key": key, "schema": kind.jsonValue(), "buckets": {}, "of": buckets, "note": {}})
        return t

    def version(self) -> int:
        return self.log.last()

    def note(self, version: int | None = None) -> dict:
        """What the writer of a version has noted with it."""
        return self.log.read(self.version() if version is None else version)["note"]

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.log.read(self.version() if version is None else version))

    def _read(self, at: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(at["schema"])
        folders = [f"{self.path}/{at['buckets'][b]}/_b={b}" for b in (at["buckets"] if buckets is None else buckets) if b in at["buckets"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, at: dict) -> Column:
        return F.pmod(F.xxhash64(at["key"]), F.lit(at["of"])).cast("int")

    def _commit(self, number: int, at: dict, rows: DataFrame, touched: list[str], note: dict) -> bool:
        """Write the rows of the touched buckets and append the version; what a loser has written is nobody's."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_b", self._bucket(at)).repartition("_b").write.partitionBy("_b").parquet(f"{self.path}/{folder}")
        full = {str(r[0]) for r in self.spark.read.parquet(f"{self.path}/{folder}").select("_b").distinct().collect()} if touched else set()
        buckets = {b: f for b, f in at["buckets"].items() if b not in touched} | {b: folder for b in full}
        return self.log.append(number + 1, {**at, "buckets": buckets, "note": note})

    def transact(self, change: Callable[[DataFrame], DataFrame], expected: int | None = None, note: dict | None = None, attempts: int = 5) -> int:
        """The number of the version made by change(the rows now). With expected it must follow that version, or is a
        Conflict; otherwise a writer that comes second makes its change again on what the first has left."""
        for _ in range(attempts):
            number = self.version() if expected is None else expected
            at = self.log.read(number)
            if self._commit(number, at, change(self._read(at)), list(at["buckets"]), note or {}):
                return number + 1
            if expected is not None:
                break
        raise Conflict(f"version {number + 1} of {self.path} is another writer's")

    def merge(self, rows: DataFrame, order: str, delete: str | None = None, expected: int | None = None, note: dict | None = None, attempts: int = 5) -> int:
        """Rows take the place of those of their keys; of one key the last by order counts, of equal orders the greatest row.
        delete names a boolean column: where it is true the key goes. Only the buckets of keys that are written are read."""
        for _ in range(attempts):
            number = self.version() if expected is None else expected
            at = self.log.read(number)
            names, key = [f["name"] for f in at["schema"]["fields"]], at["key"]
            gone = F.coalesce(F.col(delete), F.lit(False)) if delete else F.lit(False)
            body = F.struct(gone.alias("_gone"), *[F.col(c) for c in names if c != key])
            # Maps have no order; for those the order column alone decides.
            ordered = [F.struct(F.col(order), gone.alias("_gone"), *[F.to_json(F.struct(F.col(c))) for c in names if c != key])]
            last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(body, *ordered).alias("_v")).select(key, "_v.*")
            touched = [str(r[0]) for r in last.select(self._bucket(at).alias("b")).distinct().collect()]
            if not touched:
                return number
            old = self._read(at, touched).join(last.select(key), key, "left_anti").select(*names)
            if self._commit(number, at, old.unionByName(last.where(~F.col("_gone")).select(*names)), touched, note or {}):
                return number + 1
            if expected is not None:
                break
        raise Conflict(f"version {number + 1} of {self.path} is another writer's")

    def put(self, writes: DataFrame, order: str = "ord", expected: int | None = None, attempts: int = 5) -> tuple[int, DataFrame]:
        """(the version made, (key, order, etag, code, found) of each write): writes have the table's columns, etag among
        them, the order column, if_match and a code that refuses a write from the start (null for most). They are judged row
        by row (``judged``), and of those done the last of a key is what the table holds; a null etag deletes."""
        for _ in range(attempts):
            number = self.version() if expected is None else expected
            at = self.log.read(number)
            key = at["key"]
            rows = writes.where(F.col(key).isNotNull()).withColumn("code", F.col("code").cast("string"))
            said, status = judged(rows, self._read(at), key, order), f"{self.path}/status/{uuid.uuid4().hex}"
            said.write.parquet(status)
            said = self.spark.read.schema(said.schema).parquet(status)
            try:
                last = lasting(rows, said, key, order).withColumn("_none", F.col("etag").isNull())
                return self.merge(last, order, delete="_none", expected=number, note={"status": status}), said
            except Conflict:
                if expected is not None:
                    raise
        raise Conflict(f"version {number + 1} of {self.path} is another writer's")
