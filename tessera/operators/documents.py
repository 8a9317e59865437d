"""Nested documents as VARIANT: parsed once, read by path, taken apart to any depth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, out: str = "doc", problem: str = "problem") -> DataFrame:
    """df with the documents of a text column as VARIANT, and what is wrong with one: "missing" or "bad JSON", else null.
    JSON's null is a document; a repeated name keeps what Spark's parser keeps, or is bad."""
    doc = F.try_parse_json(column)
    said = F.when(F.col(column).isNull(), "missing").when(F.col(out).isNull(), "bad JSON")
    return df.withColumn(out, doc).withColumn(problem, said)


def fields(df: DataFrame, doc: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each of paths, {name: (path, type)}; null where the path leads nowhere or to another kind of value."""
    return df.withColumns({name: F.try_variant_get(doc, path, kind) for name, (path, kind) in paths.items()})


def members(df: DataFrame, doc: str, keep: Sequence[str]) -> DataFrame:
    """(keep, pos, key, value): the members of each object and the elements of each list, whose key is null; values are
    VARIANT. Others have none."""
    df = df.select(*keep, F.col(doc).alias("_doc"))
    return df.lateralJoin(_exploded("_doc")).select(*keep, "pos", "key", "value")


def _exploded(column: str) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().tvf.variant_explode(F.col(column).outer())


def leaves(df: DataFrame, doc: str, keep: Sequence[str], depth: int = 8) -> DataFrame:
    """(keep, path, kind, value): every plain value of each document, its path from $ in the manner of JSON paths and its text.
    Objects and lists are taken apart level by level, empty ones and those below depth come as they are, as JSON."""
    level = df.select(*keep, F.lit("$").alias("path"), F.col(doc).alias("value"))
    out = None
    for k in range(depth + 1):
        kind = F.schema_of_variant("value")
        nested = F.startswith(kind, F.lit("OBJECT<")) | F.startswith(kind, F.lit("ARRAY<"))
        full = nested & ~F.to_json("value").isin("{}", "[]")
        kinded = level.withColumns({"_kind": kind, "_full": F.coalesce(full, F.lit(False))})
        plain = kinded if k == depth else kinded.where(~F.col("_full"))
        text = F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))
        some = plain.where(F.col("value").isNotNull()).select(*keep, "path", F.regexp_extract("_kind", "^[A-Z]+", 0).alias("kind"), text.alias("value"))
        out = some if out is None else out.unionByName(some)
        if k < depth:
            below = kinded.where("_full").select(*keep, "path", "value").lateralJoin(_exploded("value").select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
            step = F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "_key"))
            level = below.select(*keep, F.concat("path", step).alias("path"), F.col("_value").alias("value"))
    return out
