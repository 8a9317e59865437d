"""Streams: keys kept in step with configuration maps, and tumbling windows over events."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keysync import NAME, extracted, key_map, selected


def snapshot_keys(configs: DataFrame, order: list[str], name_pattern: str = NAME, selector: str | None = None) -> DataFrame:
    """(env_name, api_key) of all configuration maps as they are now, those that the selector of labels picks."""
    return key_map(extracted(selected(configs, selector), name_pattern).where("problem is null"), "env_name", "api_key", order)


def _rebuild(snapshot, target: str, version: int, order: list[str], name_pattern: str, selector: str | None) -> None:
    keys = snapshot_keys(snapshot(), order, name_pattern, selector)
    if not keys.isEmpty():
        keys.repartitionByRange("env_name").write.mode("overwrite").parquet(f"{target}/version={version:012d}")


def sync_keys(
    spark: SparkSession, events: DataFrame, snapshot, target: str, checkpoint: str, order: list[str], name_pattern: str = NAME, selector: str | None = None, initial: bool = True, **trigger
) -> StreamingQuery:
    """First, with initial, and then whenever a matching event arrives, rebuild the key table at target from snapshot(),
    a function that reads all maps.

    Level-triggered: what an event says doesn't matter, only that something changed, so repeated and lost events do no
    harm. A snapshot without any key leaves the table as it is, so removing the last key doesn't empty it. Each rebuild
    goes to a new version below target, named by the batch, the first one before all; the reader takes the last
    (``read_keys``).
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        if not batch.where(F.col("name").rlike(name_pattern)).isEmpty():
            _rebuild(snapshot, target, epoch + 1, order, name_pattern, selector)

    if initial:
        _rebuild(snapshot, target, 0, order, name_pattern, selector)
    w = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def watch(start, pause: float = 5.0, log=print, attempts: int | None = None) -> None:
    """Run a stream, start() giving its query, and start it again after a pause whenever it fails, from its checkpoint.
    It returns where the stream ends by itself, or raises after so many attempts."""
    tried = 0
    while True:
        try:
            start().awaitTermination()
            return
        except Exception as e:  # noqa: BLE001  whatever went wrong, the next run begins where this one stopped
            tried += 1
            log(f"stream failed: {type(e).__name__}")
            if attempts is not None and tried >= attempts:
                raise
            time.sleep(pause)


def read_keys(spark: SparkSession, target: str) -> DataFrame:
    all_ = spark.read.parquet(target)
    last = all_.agg(F.max("version")).first()[0]
    return all_.where(F.col("version") == last).drop("version")


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums per window and type, with a watermark; works on streams and tables."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    w = e.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")
