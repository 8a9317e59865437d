"""Settling groups of equal keys in sorted streams, with nothing held but the last group's first rows.

Rows (k, s, t, d): k is a seed that two places share if they share a long match, s and t a digest of all the text around
the seed that a match through it can cover, d the document. Rows of one (k, s, t) are a class: they hold the same windows, so every
member of a later document than the first is settled at once. Where a seed has several classes, their first members
have to be examined more closely.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import map_arrow, mix

SCHEMA = "k long, s long, t int, d long, done boolean"
NAMES = ["k", "s", "t", "d", "done"]


def collapse(k: np.ndarray, s: np.ndarray, t: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a task sends of its rows: the first document of each class, and as done those that it settles already.

    Done rows are dealt by document, so that a seed shared by many documents doesn't gather them.
    """
    order = np.lexsort((d, t, s, k))
    k, s, t, d = k[order], s[order], t[order], d[order]
    if not len(k):
        return k, s, t, d, np.zeros(0, bool)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    again = ~new & (d == np.concatenate([d[:1], d[:-1]]))
    k, s, t, d, new, first_d = k[~again], s[~again], t[~again], d[~again], new[~again], d[first][~again]
    done = ~new & (d > first_d)
    k = np.where(done, mix(d.view(np.uint64)).view(np.int64), k)
    return k, s, t, d, done


def settle(rows: DataFrame) -> DataFrame:
    """rows (k, s, t, d, done) to (d, s, t, examine).

    examine false: all windows of class (s, t) in document d also stand in a document with a smaller number. examine
    true: d is the first document of the class, and other classes share the seed.
    """

    def run(batches):
        import pyarrow as pa

        # Of the group that the last batch ended in: its first class's first row, and its last class's if another.
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for b in batches:
            done = b.column(4).to_numpy(zero_copy_only=False)
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            out = [[c[done]] for c in (cols[3], cols[1], cols[2])]
            settled, own = int(done.sum()), len(held[0])
            k, s, t, d = now = [np.concatenate([h, c[~done]]) for h, c in zip(held, cols)]
            n = len(k)
            if n:
                new_k = np.ones(n, bool)
                new_k[1:] = k[1:] != k[:-1]
                new_s = new_k.copy()
                new_s[1:] |= (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                at = np.arange(n)
                run_first, class_first = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new_k, new_s))
                number = np.cumsum(new_s)
                number -= number[run_first]  # of the class within its group, from 0
                fresh = at >= own
                hit = np.flatnonzero(~new_s & (d > d[class_first]) & fresh)
                more = np.flatnonzero(new_s & (number >= 1) & fresh)
                firsts = run_first[more[number[more] == 1]]
                for x in (hit, more, firsts):
                    for o, c in zip(out, (d, s, t)):
                        o.append(c[x])
                settled += len(hit)
                last = [run_first[-1]] if number[-1] == 0 else [run_first[-1], class_first[-1]]
                held = [x[last] for x in now]
            made = [np.concatenate(o) for o in out]
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(np.arange(len(made[0])) >= settled)], ["d", "s", "t", "examine"])

    return map_arrow(rows.repartition("k").sortWithinPartitions("k", "s", "t", "d"), run, "d long, s long, t int, examine boolean")
