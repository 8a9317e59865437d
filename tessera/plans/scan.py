"""Running values within groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def segmented_scan(df: DataFrame, by: Sequence[str], order: Sequence[str], outs: Mapping[str, tuple[str, Column | None]], ranges: int | None = None) -> DataFrame:
    """df with, for each of outs, what the rows before a row within its group come to, by order: ``count`` of them, or the
    ``sum``, ``max`` or ``last`` of an expression over them; null where there is none, 0 for count. ``by`` may be empty.

    Rows are dealt by ranges of (by, order), so a group of many rows is spread over many tasks, and written. Each piece of a
    group then leaves one row with what it comes to, those rows are summed up along each group, and enter the next pieces as
    their first row: one more shuffle, no join, and nothing on the driver. The order should tell rows of a group apart; rows
    that it doesn't stand in some order, but always in the same piece. Null groups are a group, null orders come first."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {out: f"_v{i}" for i, out in enumerate(outs)}
    valued = df.withColumns({names[o]: F.lit(1).cast("long") if kind == "count" else value for o, (kind, value) in outs.items()})
    dealt = written(valued.repartitionByRange(n, *by, *order).withColumn("_piece", F.spark_partition_id()))
    place = F.struct(*order)
    total = {"count": F.sum, "sum": F.sum, "max": F.max, "last": lambda v: F.max_by(F.struct(v), place)}
    pieces = dealt.groupBy("_piece", *by).agg(*[total[kind](F.col(names[o])).alias(names[o]) for o, (kind, _) in outs.items()])
    along = W.partitionBy(*by).orderBy("_piece")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    carried = {"count": lambda v: F.sum(v).over(before), "sum": lambda v: F.sum(v).over(before), "max": lambda v: F.max(v).over(before), "last": lambda v: F.lag(v).over(along).getField(v)}
    carry = pieces.select("_piece", *by, (F.row_number().over(along) > 1).alias("_after"), *[carried[kind](names[o]).alias(names[o]) for o, (kind, _) in outs.items()])
    both = dealt.withColumn("_kind", F.lit(1)).unionByName(carry.where("_after").drop("_after").withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    within = W.partitionBy("_piece", *by).orderBy("_kind", *order)
    so_far = within.rowsBetween(W.unboundedPreceding, -1)
    run = {"count": lambda v: F.coalesce(F.sum(v).over(so_far), F.lit(0)), "sum": lambda v: F.sum(v).over(so_far), "max": lambda v: F.max(v).over(so_far), "last": lambda v: F.lag(v).over(within)}
    done = both.withColumns({o: run[kind](names[o]) for o, (kind, _) in outs.items()})
    return done.where("_kind = 1").select(*df.columns, *outs)
