"""What the operators of this subpackage share: reading, shipping code, cutting lineage, hashing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run.

    The package is zipped once per application and handed to Spark, which serves it to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", None) == os.getpid():
        return
    folder = tempfile.mkdtemp(prefix="tessera-")
    target = os.path.join(folder, f"{ROOT.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(target)
    sc._tessera_shipped = os.getpid()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one is set in local mode,
    whose only process reads and writes it; on a cluster it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(sc, "_tessera_shared", None)
    if not found:
        if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = sc._tessera_shared = tempfile.mkdtemp(prefix="tessera-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, executors may be lost.

    The files stay until ``drop_stored`` or until the folder is cleared, as any later plan may read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored_paths(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_paths(spark: SparkSession) -> list[str]:
    """What ``stored`` has written in this application and nobody has deleted, the latest last."""
    return spark.sparkContext.__dict__.setdefault("_tessera_stored", [])


def drop_stored(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what ``stored`` has written in this application, or some of it; frames built on it can't be used any more."""
    jvm, sc = spark._jvm, spark.sparkContext
    every = stored_paths(spark)
    for path in list(every if paths is None else paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        every.remove(path)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with this package shipped to the workers, which give back the memory of a task when it ends: they wait for
    others, beside an executor's heap."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand memory that this process has freed back to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def sorted_groups(batches, columns: int, most: int):
    """Groups of equal values in the first column of a sorted stream: (arrays, starts, ends, large) again and again.

    starts and ends are of whole groups of up to ``most`` rows. large are ranges of parts of larger groups, given out as
    they come, so no more than ``most`` rows and a batch are held.
    """
    rest, over = None, None
    for b in then_none(batches):
        now = None if b is None else [b.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if now is not None and not len(now[0]):
            continue
        if now is None and rest is None:
            return
        if rest is not None:
            now = rest if now is None else [np.concatenate(x) for x in zip(rest, now)]
        key = now[0]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        ends = np.append(starts[1:], len(key))
        big = ends - starts > most
        big[0] |= over is not None and key[0] == over
        whole = np.ones(len(starts), bool)
        whole[-1] = b is None
        yield now, starts[whole & ~big], ends[whole & ~big], list(zip(starts[big].tolist(), ends[big].tolist()))
        if b is None:
            return
        over = key[-1] if big[-1] else None
        rest = None if big[-1] else [x[starts[-1] :] for x in now]


def then_none(batches):
    yield from batches
    yield None


def with_column(keep, column: str) -> tuple[list[str], int]:
    """The columns to hand to a worker so that it has keep, in order, and column, and where that one stands."""
    names = list(keep) + ([column] if column not in keep else [])
    return names, names.index(column)


# ---------------------------------------------------------------- hashing in numpy

_U = np.uint64
#: What chains of mixed values start from; any number with well mixed bits will do.
_START = _U(0x9E3779B97F4A7C15)
#: Bytes from which a word is hashed by itself.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian integer; zeros stand behind the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def runs(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of n values in a row from each of some places, in their order; each step is mixed."""
    h = np.full(len(at), _START + _U(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            h = mix(h + values[at + j])
    return h


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each range of bytes, as a long and an int: XXH3 of the bytes themselves, so ranges that are equal there
    are taken to be equal. Among 10^12 different ranges any two agree with a chance of 6e-6."""
    from xxhash import xxh3_128_digest

    found = b"".join([xxh3_128_digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(found, np.dtype([("s", "<i8"), ("t", "<i4"), ("rest", "<i4")]))
    return both["s"].copy(), both["t"].copy()


def among(s: np.ndarray, t: np.ndarray, of_s: np.ndarray, of_t: np.ndarray) -> np.ndarray:
    """Which pairs (s, t) are among others."""
    every_s, every_t = np.concatenate([s, of_s]), np.concatenate([t, of_t])
    order = np.lexsort((every_t, every_s))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(every_s[order]) != 0) | (np.diff(every_t[order]) != 0)
    group = np.cumsum(new) - 1
    there = np.zeros(len(order), bool)
    there[group[order >= len(s)]] = True
    out = np.zeros(len(s), bool)
    own = order < len(s)
    out[order[own]] = there[group[own]]
    return out


#: The bytes that part words: space, and tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a whole Arrow string column, and the n + 1 offsets of its rows; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words_of(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of all words (runs of bytes that aren't gaps, white space unless others are named, never
    across rows), and the n + 1 offsets of the rows in words."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~gaps[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] |= inside[firsts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stops[lasts] |= inside[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def row_blocks(offsets: np.ndarray, most: int = 2_000_000):
    """Row ranges (a, b) whose bytes are at most ``most`` together, or a single longer row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone: eight bytes at a time, each step mixed, or XXH3 of long ones."""
    from xxhash import xxh3_64_intdigest

    size, view = ends - starts, eights(raw)
    h = mix(_START + size.astype(np.uint64))
    going = np.flatnonzero(size <= LONG_WORD)
    at, left = starts[going], size[going]
    while len(going):
        chunk = view[at] & (_U(2**64 - 1) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))
        h[going] = mix(h[going] ^ chunk)
        more = left > 8
        going, at, left = going[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return h


def one_space(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where they start and end there. Ranges of words are equal where their
    bytes are, whatever parted them in the text."""
    size = ends - starts
    new_ends = np.cumsum(size + 1) - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[new_ends] = False
    out[letters] = raw[~IS_SPACE[raw]]
    return out.tobytes(), new_ends - size, new_ends
