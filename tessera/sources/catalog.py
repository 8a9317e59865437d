"""Files as named tables: CSV folders as a catalog, and data sets with their splits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .files import split_scan


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file, or a folder of them, with a header. Only an empty field is null: NA and the like are values. Without a
    schema all columns are text, so nothing is read twice."""
    r = spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False)
    return (r.schema(schema) if schema else r).csv(path)


def csv_catalog(spark: SparkSession, tables: Mapping[str, str], schemas: Mapping[str, str] | None = None) -> None:
    """Each path as a temporary view by its name, for plain SQL."""
    for name, path in tables.items():
        read_csv(spark, path, (schemas or {}).get(name)).createOrReplaceTempView(name)


@dataclass(frozen=True)
class Dataset:
    """What is known of a data set: its table with a column split, its channels and the names of its classes."""

    path: str
    channels: int
    labels: tuple[str, ...]


def get_datasets(spark: SparkSession, known: Mapping[str, Dataset], name: str) -> tuple[DataFrame, DataFrame, DataFrame, Dataset]:
    """(train, val, test, info); an unknown name is an error before anything is read."""
    if name not in known:
        raise ValueError(f"unknown data set {name!r}")
    info = known[name]
    rows = spark.read.parquet(info.path)
    return *(split_scan(rows, s) for s in ("train", "val", "test")), info
