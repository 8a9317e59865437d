"""Joins of two streams by time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from .state import use_state_store

#: Rows of one cell that are held as one row of state, rows that a task sorts at once, and pairs given out at once.
PACK, SORTED, PAIRS = 2_048, 200_000, 100_000


def stream_interval_join(a: DataFrame, b: DataFrame, times: tuple[str, str], before: int, after: int, delay: str = "1 hour", on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Pairs of rows of two streams with b's time later than a's less ``before`` seconds and earlier than a's plus ``after``
    seconds, and equal ``on``; the times are the columns named, of different names. With how="left_outer" and ``on`` rows
    of a without a partner come too, when none can come any more.

    Each stream has its watermark, its newest time less delay; rows behind it are dropped, without ``on`` only those that no
    newer row of their cell comes with. The bounds on the times tell Spark how long a row may still find partners, so state
    is a window of the two streams and not their past. Without ``on`` the rows are dealt into cells of time, a's into each
    that its partners may lie in: the pair meets once, in b's own cell. The rows that a batch brings to a cell are held by
    the PACK as one row of state, in order of time, so partners are looked up in sorted arrays and only pairs cost; the
    pairs have the columns of both, without a watermark."""
    use_state_store(a.sparkSession)
    ta, tb = times
    a, b = (df.withColumn(t, F.col(t).cast("timestamp")).where(F.col(t).isNotNull()) for df, t in ((a, ta), (b, tb)))
    if on:
        a, b = a.withWatermark(ta, delay), b.withWatermark(tb, delay)
        near = (F.col(tb) > F.expr(f"{ta} - INTERVAL {before} SECONDS")) & (F.col(tb) < F.expr(f"{ta} + INTERVAL {after} SECONDS"))
        b = b.withColumnsRenamed({c: f"_{c}" for c in on})
        for c in on:
            near = near & (F.col(c) == F.col(f"_{c}"))
        return a.join(b, near, how).drop(*[f"_{c}" for c in on])
    if how != "inner":
        raise ValueError("outer rows need columns to join on")
    ship(a.sparkSession)
    width = max(1, before + after)
    cell = lambda t: F.floor(F.unix_micros(t) / (width * 1_000_000))
    reached = F.explode(F.sequence(cell(F.expr(f"{ta} - INTERVAL {before} SECONDS")), cell(F.expr(f"{ta} + INTERVAL {after} SECONDS"))))
    left = _packed(a, ta, reached, "a").withWatermark("_newest_a", delay)
    right = _packed(b, tb, cell(F.col(tb)), "b").withWatermark("_newest_b", delay)
    # The times of a's rows in a cell lie within twice its width, those of b's within its width: what may meet is no farther
    # apart, by the newest times of two packs, than this.
    low, high = F.expr(f"_newest_a - INTERVAL {before + 2 * width} SECONDS"), F.expr(f"_newest_a + INTERVAL {after + width} SECONDS")
    met = left.join(right, (F.col("_cell_a") == F.col("_cell_b")) & (F.col("_newest_b") > low) & (F.col("_newest_b") < high), "inner")
    # A cell may hold many packs; which task takes two of them apart doesn't depend on the cell.
    met = met.select("_pack_a", "_pack_b").repartition(F.xxhash64("_pack_a", "_pack_b"))
    return _taken_apart(met, a.schema, b.schema, (a.columns.index(ta), b.columns.index(tb)), before, after)


def _packed(df: DataFrame, t: str, cell, tag: str) -> DataFrame:
    """(_cell, _newest, _pack, each with the tag) of a stream: up to PACK rows of a cell by time, as Arrow's bytes, and the
    newest of their times."""
    at = df.columns.index(t)

    def run(batches):
        import pyarrow as pa

        def packs(held):
            rows = pa.Table.from_batches(held).combine_chunks()
            cells, time = rows.column(rows.num_columns - 1).to_numpy(), rows.column(at).cast(pa.int64()).to_numpy()
            order = np.lexsort((time, cells))
            cells, time, rows = cells[order], time[order], rows.drop_columns(["_cell"]).take(pa.array(order))
            starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            cuts = [x for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]) for x in range(s, e, PACK)]
            ends = [*cuts[1:], len(cells)]
            for k in range(0, len(cuts), 64):
                data = [_bytes(rows.slice(s, e - s)) for s, e in zip(cuts[k : k + 64], ends[k : k + 64])]
                newest = time[np.array(ends[k : k + 64]) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(cells[cuts[k : k + 64]]), pa.array(newest, pa.timestamp("us", "UTC")), pa.array(data, pa.binary())], names)

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= SORTED:
                yield from packs(held)
                held, n = [], 0
        if n:
            yield from packs(held)

    names = [f"_cell_{tag}", f"_newest_{tag}", f"_pack_{tag}"]
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    dealt = df.withColumn("_cell", cell).toDF(*numbered.columns, "_cell").repartition("_cell")
    return dealt.mapInArrow(run, f"{names[0]} long, {names[1]} timestamp, {names[2]} binary")


def _bytes(rows) -> bytes:
    import pyarrow as pa

    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _taken_apart(met: DataFrame, a: StructType, b: StructType, at: tuple[int, int], before: int, after: int) -> DataFrame:
    """The pairs of rows of each two packs whose times are near enough, PAIRS at a time."""
    names = [f"c{i}" for i in range(len(a) + len(b))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, [*a, *b]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = (pa.ipc.open_stream(p.as_buffer()).read_all().combine_chunks() for p in (x, y))
                ta, tb = x.column(at[0]).cast(pa.int64()).to_numpy(), y.column(at[1]).cast(pa.int64()).to_numpy()
                lo = np.searchsorted(tb, ta - before * 1_000_000, side="right")
                n = np.maximum(0, np.searchsorted(tb, ta + after * 1_000_000, side="left") - lo)
                ends = np.cumsum(n)
                first = 0
                while first < len(n):
                    # whole rows of a, of PACK pairs at most each
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + PAIRS, side="right")))
                    some = n[first:last]
                    if some.any():
                        i = np.repeat(np.arange(first, last), some)
                        j = np.arange(len(i)) + np.repeat(lo[first:last] - (np.cumsum(some) - some), some)
                        both = [*x.take(pa.array(i)).columns, *y.take(pa.array(j)).columns]
                        yield from pa.Table.from_arrays(both, names).combine_chunks().to_batches()
                    first = last

    return met.mapInArrow(run, kinds).toDF(*a.names, *b.names)
