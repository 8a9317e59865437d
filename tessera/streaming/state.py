"""Keyed state over streams of changes: the last value of each key, and its deletion."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state of a key is, and what comes out where it changes.
LAST = "version bigint, ord bigint, value string, deleted boolean, at bigint"
CHANGED = "key string, version bigint, ord bigint, op string, value string"


def use_state_store(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; this sets it for the session's later streams. Its files are uploaded to
    the checkpoint with each batch, so state outlives executors: what a batch has changed, and all of it now and then. A
    join keeps one store a partition, not four."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")


class LastValue(StatefulProcessor):
    """The newest change of a key by (version, ord). Rows that aren't newer than the state, late or repeated, change nothing.

    A deleted key leaves a tombstone, so an older change that arrives after it can't bring the key back. A timer takes the
    tombstone away when the watermark has passed the deletion by ``keep`` milliseconds; nothing that old arrives any more if
    keep is no less than the watermark's delay. What is held is one row a key."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.last.get() if self.last.exists() else None
        place = (old[0], old[1]) if old is not None else (-1, -1)
        best = None
        for r in rows:
            if (r.version, r.ord) > place:
                best, place = r, (r.version, r.ord)
        if best is None:
            return
        deleted = best.op == "DELETE"
        if old is not None and old[3]:
            self.handle.deleteTimer(old[4] + self.keep)
        self.last.update((best.version, best.ord, None if deleted else best.value, deleted, best.at))
        if deleted:
            self.handle.registerTimer(best.at + self.keep)
        yield Row(key=key[0], version=best.version, ord=best.ord, op=best.op, value=None if deleted else best.value)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.last.exists() and self.last.get()[3]:
            self.last.clear()
        return iter([])


def last_values(changes: DataFrame, delay: str = "1 hour", keep: int = 3_600_000, ts: str = "ts") -> DataFrame:
    """CHANGED rows of a stream of changes (key, version, ord, op, value, ts): those that were the newest of their key when
    their batch came. Rows later than delay behind the newest time seen are dropped; rows without a key are left out."""
    use_state_store(changes.sparkSession)
    at = changes.where(F.col("key").isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).withColumn("at", F.unix_millis(ts))
    return at.groupBy("key").transformWithState(LastValue(keep), outputStructType=CHANGED, outputMode="append", timeMode="EventTime")


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, version, value, deleted) as the state store of a stopped stream holds them, tombstones included."""
    rows = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return rows.select("key.key", "value.version", "value.ord", "value.value", "value.deleted")
