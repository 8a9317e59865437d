"""Nested configuration to flat environment entries."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import sanitize


def _part(spec: str) -> Column:
    """One placeholder: a field path, then |sanitize or |upper; a path that ends in ? may be null and then is ''."""
    path, *calls = spec.split("|")
    optional = path.endswith("?")
    c = F.col(path.rstrip("?")).cast("string")
    c = F.coalesce(c, F.lit("")) if optional else c
    for call in calls:
        c = {"sanitize": sanitize, "upper": F.upper, "lower": F.lower}[call](c)
    return c


def render(templates: Mapping[str, str]) -> list[tuple[str, Column]]:
    """(key, value) of each entry. A template is text with {path}, {path?} or {path|function} in it."""
    out = []
    for key, t in templates.items():
        parts = [_part(x[1:-1]) if x[0] == "{" else F.lit(x) for x in re.findall(r"\{[^}]*\}|[^{]+", t)]
        out.append((key, F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.lit("")))
    return out


def render_env(config: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """One row (ord, key, value) for each template and row of config, in the templates' order."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), v.alias("value")) for i, (k, v) in enumerate(render(templates))])
    return config.select(F.explode(rows).alias("e")).select("e.*")


def env_lines(entries: DataFrame) -> DataFrame:
    """KEY=VALUE lines in insertion order: partitions are ranges of it, each sorted, for a text sink whose files are in the
    order of their names."""
    return entries.select("ord", F.concat_ws("=", "key", "value").alias("value")).repartitionByRange("ord").sortWithinPartitions("ord").select("value")


def write_env(entries: DataFrame, path: str) -> None:
    """A folder with text files of KEY=VALUE lines, in the entries' order by file name and line."""
    env_lines(entries).write.mode("overwrite").text(path)


def load_config(spark, path: str) -> DataFrame:
    """One row with the nested fields of a JSON file, or of a YAML file where a YAML library is installed; a missing
    file is an error."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not path.endswith(".json"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need a YAML library; give JSON") from e
        text = json.dumps(yaml.safe_load(text))
    schema = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
    return spark.range(1).select(F.from_json(F.lit(text), schema).alias("c")).select("c.*")
