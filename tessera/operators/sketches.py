"""Summaries that are made once, stored and merged later: distinct counts, quantiles and frequencies within stated errors.

A sketch is a column, so a table of sketches by day is a table like any other: written as Parquet, added to, merged by month
without the rows that it was made of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: HyperLogLog of 2^LOG registers; KLL of parameter K; count-min of ROWS hashes, each over WIDTH counters.
LOG, K, ROWS, WIDTH = 12, 200, 5, 4096
#: Their errors. Distinct: three standard errors, relative; merged sketches are unions, whose error is 1.04 / sqrt(2^LOG) as well.
#: Quantiles: in rank, as a share of all rows, 99 % of the time. Frequencies: never below, above by at most this share of all
#: rows but for e^-ROWS of the items.
DISTINCT_ERROR, RANK_ERROR, COUNT_ERROR = 3 * 1.04 / 2 ** (LOG / 2), 0.0165, 2.718281828 / WIDTH


def sketched(df: DataFrame, by: Sequence[str], distinct: str, values: str) -> DataFrame:
    """(by, n, distinct_sketch, value_sketch): how many rows, the different values of one column, the quantiles of another.
    Nulls are in neither sketch. Both are combined in the tasks before the shuffle."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, LOG).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(values).cast("double"), K).alias("value_sketch"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same columns for fewer groups, from sketches alone."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimated(sketches: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """The groups with n, distinct (estimated) and quantiles, one estimate for each that is asked for."""
    rest = [c for c in sketches.columns if c not in ("distinct_sketch", "value_sketch")]
    at = F.kll_sketch_get_quantile_double("value_sketch", F.array(*[F.lit(float(q)) for q in quantiles]))
    return sketches.select(*rest, F.hll_sketch_estimate("distinct_sketch").alias("distinct"), at.alias("quantiles"))


def _places(item: Column) -> Column:
    """The counter of an item in each row of a count-min sketch."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), item), F.lit(WIDTH)).cast("int") for i in range(ROWS)])


def frequencies(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """(by, row, place, n): a count-min sketch of each group, its counters as rows, those of nothing left out. A group has
    ROWS times WIDTH of them at most, whatever it counts. Null items are an item."""
    each = df.select(*by, F.posexplode(_places(F.col(item))).alias("row", "place"))
    return each.groupBy(*by, "row", "place").agg(F.count("*").alias("n"))


def merged_frequencies(counters: DataFrame, by: Sequence[str]) -> DataFrame:
    return counters.groupBy(*by, "row", "place").agg(F.sum("n").alias("n"))


def looked_up(counters: DataFrame, items: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """items (by, item) with estimate: the least of the item's counters in its group, 0 where one was never raised."""
    asked = items.select(*by, item).distinct().select(*by, item, F.posexplode(_places(F.col(item))).alias("row", "place"))
    found = asked.join(counters, [*by, "row", "place"], "left")
    return found.groupBy(*by, item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
