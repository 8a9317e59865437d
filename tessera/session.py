"""Sessions and views over the tables of a directory."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds or overrides settings."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run: it is zipped once for each application and
    handed to Spark, which serves it to every executor. What Spark starts beside the driver, as for streams, finds it by path."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(root.parent) not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(root.parent), *filter(None, paths)])
    if getattr(sc, "_tessera_shipped", None) == os.getpid():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._tessera_shipped = os.getpid()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables, by name."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def read_or(spark: SparkSession, first: str, fallback: str) -> DataFrame:
    """The table at first, or the one at fallback where first can't be read (a cache and what it was filled from): the
    path is missing, the files are no Parquet, or a first row can't be had."""
    try:
        found = spark.read.parquet(first)
        found.limit(1).collect()
    except Exception:  # noqa: BLE001  whatever keeps a cache from being read, the source is there
        return spark.read.parquet(fallback)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or one of the machine's own in
    local mode, where only one process reads it."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.removeprefix('file://').rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read back: what comes after doesn't work it out again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
