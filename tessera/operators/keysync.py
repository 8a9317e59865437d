"""Keys out of configuration maps: extraction, last one wins, hashes, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import canonical_json, env_name_safe, short_hash
from ..plans.scan import segmented_scan

NAME = "^deploymentconfig-(.+)$"


def selected(configs: DataFrame, selector: str | None, labels: str = "labels") -> DataFrame:
    """Rows whose labels meet a selector: name=value, name!=value, name or !name, joined by commas; none selects all.
    A name that is missing meets name!=value."""
    for part in (selector or "").split(","):
        name, sign, value = part.partition("!=") if "!=" in part else part.partition("=")
        name, value = name.strip(), value.lstrip("=").strip()
        at = F.try_element_at(labels, F.lit(name.lstrip("!")))
        if sign:
            met = at == value
            configs = configs.where(F.coalesce(met, F.lit(False)) if sign == "=" else ~F.coalesce(met, F.lit(False)))
        elif name:
            configs = configs.where(at.isNull() if name.startswith("!") else at.isNotNull())
    return configs


def extracted(configs: DataFrame, name_pattern: str = NAME) -> DataFrame:
    """Rows whose name matches, with namespace, model, api_key, env_name and problem ("bad JSON" or "missing"). A document is
    parsed once; what isn't a plain value there counts as missing."""
    doc = F.try_parse_json("deploymentConfig")
    at = lambda p: F.try_variant_get("_doc", p, "string")
    named = configs.where(F.col("name").rlike(name_pattern)).withColumn("_doc", doc)
    out = named.withColumns({"model_namespace": at("$.Namespace"), "model": at("$.Name"), "api_key": at("$.ExternalEndpoint.ApiKey")})
    problem = F.when(F.col("deploymentConfig").isNull(), "missing").when(F.col("_doc").isNull(), "bad JSON").when(F.coalesce(F.col("api_key"), F.lit("")) == "", "missing")
    return out.withColumn("env_name", env_name_safe(F.concat("model_namespace", F.lit("_"), "model"))).withColumn("problem", problem).drop("_doc")


def key_map(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the last value of each key by the order given; empty and null values are left out."""
    some = rows.where(F.col(value).isNotNull() & (F.col(value) != ""))
    return some.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def keys_hash(keys: Column) -> Column:
    """Eight hex digits that change where any entry of a map does."""
    return short_hash(canonical_json(keys))


def rollouts(df: DataFrame, by: str, order: list[str], content: Column, large: bool = False) -> DataFrame:
    """df with hash, previous and roll_out: whether the content's hash differs from the row before; the first rolls out.
    With large a group is spread over the tasks; otherwise it is one sorted partition."""
    hashed = df.withColumn("hash", short_hash(content))
    if large:
        out = segmented_scan(hashed, [by], order, {"previous": ("last", F.col("hash"))})
    else:
        out = hashed.withColumn("previous", F.lag("hash").over(W.partitionBy(by).orderBy(*order)))
    return out.withColumn("roll_out", ~F.col("hash").eqNullSafe(F.col("previous")))


def missing_refs(containers: DataFrame, refs: DataFrame, on: str) -> DataFrame:
    """Containers that lack a reference."""
    return containers.join(refs.select(on), on, "left_anti")


def with_refs(refs: DataFrame, missing: DataFrame) -> DataFrame:
    return refs.unionByName(missing)
