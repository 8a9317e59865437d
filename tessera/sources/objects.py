"""An object store as a table of objects; reads give error columns, never exceptions, and writes give new tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import OCTET_STREAM, iso_time, text_or_base64
from .files import files
from .versioned import judged, lasting

#: The largest object that is read or written; exactly this size is allowed.
CAP = 50 * 1024 * 1024


def list_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    """(key, size, last_modified as ISO text) of keys with a prefix."""
    return objects.where(F.startswith("key", F.lit(prefix))).select("key", "size", iso_time(F.col("last_modified")).alias("last_modified"))


def scan_folder(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Objects of a folder of a file system or store, contents left unread until they are asked for; with a prefix only the
    directories that it names are listed. Spark's reader leaves out empty objects; ``list_folder`` has them."""
    at, last = path.rstrip("/") + "/" + prefix, "" if not prefix or prefix.endswith("/") else "*"
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(at.rstrip("/") + last if last or prefix else path)
    return b.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), "content")


def list_folder(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(key, size, last_modified) of the objects of a mounted folder whose keys, their paths below it, have a prefix. The walk
    begins at the last directory of the prefix and keeps to it; no content is opened."""
    root = os.path.abspath(path).rstrip("/") + "/"
    found = files(spark, path).where((F.col("type") == "file") & F.startswith("path", F.lit(root + prefix)))
    return found.select(F.substr("path", F.lit(len(root) + 1)).alias("key"), "size", iso_time(F.timestamp_micros((F.col("modified") * 1e6).cast("long"))).alias("last_modified"))


def list_buckets(objects: DataFrame) -> DataFrame:
    """(name, creation_date): first parts of the keys, with the earliest time below each."""
    return objects.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("name")).agg(iso_time(F.min("last_modified")).alias("creation_date"))


def get_objects(objects: DataFrame, cap: int = CAP) -> DataFrame:
    """(key, content, content_type, encoding, etag, error, code): text and JSON as UTF-8 where they are, else Base64.
    Objects above the cap have an error and no content; theirs is never read, as the size is a filter of the scan."""
    kind = F.coalesce("content_type", F.lit(OCTET_STREAM))
    is_text = kind.like("text/%") | (kind == "application/json")
    content, encoding = text_or_base64(F.col("content"), is_text)
    fits = (F.col("size") <= cap) | F.col("size").isNull()
    none = F.lit(None).cast("string")
    said = F.concat(F.lit("Object larger than "), F.lit(str(cap)), F.lit(" bytes"))
    small = objects.where(fits).select("key", content.alias("content"), kind.alias("content_type"), encoding.alias("encoding"), "etag", none.alias("error"), none.alias("code"))
    large = objects.where(F.col("size") > cap)
    return small.unionByName(large.select("key", none.alias("content"), kind.alias("content_type"), none.alias("encoding"), "etag", said.alias("error"), F.lit("OBJECT_TOO_LARGE").alias("code")))


def put_objects(objects: DataFrame, new: DataFrame, cap: int = CAP, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the table after the writes, a status row for each): new has key, content (text), content_type, if_match and, where
    a key is written more than once, the order of the writes; without one they are taken by etag.

    Pictures and octet streams are decoded from Base64. Each write is judged by what those before it have left; one whose
    if_match isn't the etag then, or which is too large, changes nothing. The etag is the content's MD5."""
    binary = F.col("content_type").like("image/%") | (F.col("content_type") == OCTET_STREAM)
    body = F.when(binary, F.unbase64("content")).otherwise(F.encode("content", "UTF-8"))
    w = new.select("key", "content_type", body.alias("content"), "if_match", (F.col(order) if order else F.lit(0)).alias("ord"))
    w = w.withColumns({"etag": F.md5("content"), "code": F.when(F.octet_length("content") > cap, "OBJECT_TOO_LARGE")})
    said = judged(w.select("key", "ord", "if_match", "etag", "code"), objects)
    good = lasting(w, said).select("key", F.octet_length("content").cast("long").alias("size"), F.current_timestamp().alias("last_modified"), "content_type", "etag", "content")
    after = objects.join(good.select("key"), "key", "left_anti").unionByName(good)
    names = ["key", *([F.col("ord").alias(order)] if order else [])]
    return after, said.select(*names, F.when(F.col("code").isNull(), "ok").otherwise("error").alias("status"), "code")


def delete_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the keys; keys that aren't there are no error."""
    return objects.join(keys.select("key"), "key", "left_anti")


def existing(wanted: DataFrame, objects: DataFrame, on: str = "key") -> DataFrame:
    """The keys that are there."""
    return wanted.join(objects.select(on), on, "left_semi")
