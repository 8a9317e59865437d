"""Removal of repeated byte strings by suffix arrays over shards, each sorted by external induced sorting.

A shard must hold every place of a string that it is to find. So documents are parted by seeds: the seed of a window of
100 bytes is the least hash of the 20-byte strings in it, and equal windows have equal seeds wherever they stand.
Neighbouring windows of one seed make a stretch, and all stretches of a seed go to one shard. Stretches whose seed
stands nowhere else can't repeat; equal stretches are combined before they are sent, told by 96-bit digests of their
bytes. What is left, stretches that share a seed and differ or hold it twice themselves, is written out, sorted with its
common-prefix values (``induced``), and every window that shares 100 bytes with an earlier one is marked. Stretches of a
seed that very many have, as at the edges of a passage that stands in many documents, are parted once more by the second
least hash of their windows, so they spread over shards. A shard of any size is worked on in files.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digests, eights, map_arrow, mix, row_blocks, stored, text_bytes
from .induced import IN_MEMORY, Spool, suffixes

GRAM = 20
#: Windows in a stretch at most, bytes of a text worked on at once, and bytes of a shard from which the next one starts.
STRETCH, SEGMENT, SHARD = 300, 1 << 18, 2_500_000
#: Bytes of a shard up to which it is held in memory, stretches of a seed from which it is hot, and hot seeds up to which
#: their list is sent to every executor.
HELD, HOT, FEW_HOT = 16_000_000, 4096, 50_000
_LEN_BITS = 20
TWICE = 1 << (_LEN_BITS - 1)


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 20 bytes from each place on; it only chooses seeds."""
    view, n = eights(raw), len(raw) - GRAM + 1
    with np.errstate(over="ignore"):
        h = view[:n] * np.uint64(0xD6E8FEB86659FD93)
        h ^= mix(view[8 : n + 8] + h)
        return mix(h + (view[12 : n + 12] >> np.uint64(32)))


def _stretches(raw: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, seed, 96 bits of content in two, start in the row, bytes) of all stretches of some texts; bytes has TWICE
    added where the seed stands more than once in the stretch."""
    n = len(raw) - window + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.int32), z, z
    least = grams = _grams(raw)
    width, reach = window - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    whole = row[:n] == row[window - 1 :]
    cut = np.ones(n, bool)
    cut[1:] = (least[1:] != least[:-1]) | ~whole[1:] | ~whole[:-1] | (row[1:n] != row[: n - 1])
    first = np.flatnonzero(cut)
    size = np.append(first[1:], n) - first
    if size.max() > STRETCH:
        parts = -(-size // STRETCH)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(first + size, parts)
        first = np.repeat(first, parts) + step * STRETCH
        size = np.minimum(STRETCH, end - first)
    good = whole[first]
    first, size = first[good], size[good]
    end = first + size + window - 1
    seed = least[first]
    held = end - first - GRAM + 1
    begins = np.cumsum(held) - held
    inside = np.arange(held.sum()) + np.repeat(first - begins, held)
    times = np.add.reduceat((grams[inside] == np.repeat(seed, held)).astype(np.int32), begins) if len(first) else held
    s, t = digests(raw.tobytes(), first, end)
    return row[first], seed.view(np.int64), s, t, first - offsets[row[first]], end - first + TWICE * (times > 1)


def _segments(raw: np.ndarray, offsets: np.ndarray, window: int):
    """(row of the first text, bytes, offsets, place in the text) of parts of some texts that hold each window once."""
    for i, j in row_blocks(offsets, SEGMENT):
        size = int(offsets[j] - offsets[i])
        if j - i > 1 or size <= 2 * SEGMENT:
            yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 0
        else:
            for a in range(0, size - window + 1, SEGMENT):
                e = min(size, a + SEGMENT + window - 1)
                yield i, raw[offsets[i] + a : offsets[i] + e], np.array([0, e - a]), a


_SCHEMA = "k long, s long, t int, d long, place long, done boolean"
_NAMES = ["k", "s", "t", "d", "place", "done"]


def _pack(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Start and bytes of a stretch as one integer that sorts by start."""
    return (start << _LEN_BITS) | size


def _collapse(k: np.ndarray, s: np.ndarray, t: np.ndarray, d: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first of equal stretches stays with its seed; the others are done, and dealt by document."""
    order = np.lexsort((place, d, t, s, k))
    k, s, t, d, place = (x[order] for x in (k, s, t, d, place))
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    same = ~new & (d == d[first]) & (place == place[first])
    done = ~new & ~same
    k = np.where(done, mix(d.view(np.uint64)).view(np.int64), k)
    return *(x[~same] for x in (k, s, t, d, place)), done[~same]


def _settle(rows: DataFrame) -> DataFrame:
    """(d, place, k, examine): examine false for stretches that equal an earlier one, true for the first ones of seeds
    that have several, or stand twice in a stretch. A sorted stream; held is no more than two rows of the seed at a batch's end."""

    def run(batches):
        import pyarrow as pa

        held = [np.zeros(0, np.int32 if i == 2 else np.int64) for i in range(5)]
        for b in batches:
            done = b.column(5).to_numpy(zero_copy_only=False)
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            out = [(cols[3][done], cols[4][done], cols[0][done])]
            own = len(held[0])
            k, s, t, d, place = now = [np.concatenate([h, c[~done]]) for h, c in zip(held, cols)]
            flags = int(done.sum())
            if len(k):
                at = np.arange(len(k))
                new_k = np.ones(len(k), bool)
                new_k[1:] = k[1:] != k[:-1]
                new_s = new_k.copy()
                new_s[1:] |= (s[1:] != s[:-1]) | (t[1:] != t[:-1])
                run_first, class_first = (np.maximum.accumulate(np.where(x, at, 0)) for x in (new_k, new_s))
                number = np.cumsum(new_s)
                number -= number[run_first]
                fresh = at >= own
                again = np.flatnonzero(~new_s & fresh & ((d != d[class_first]) | (place != place[class_first])))
                more = np.flatnonzero(new_s & (number >= 1) & fresh)
                alone = (place & TWICE) > 0
                lead = run_first[more[number[more] == 1]]
                look = np.concatenate([lead[~alone[lead]], more, np.flatnonzero(new_s & (number == 0) & fresh & alone)])
                out += [(d[x], place[x], k[x]) for x in (again, look)]
                flags += len(again)
                last = [run_first[-1]] if number[-1] == 0 else [run_first[-1], class_first[-1]]
                held = [x[last] for x in now]
            d2, p2, k2 = (np.concatenate(x) for x in zip(*out))
            if len(d2):
                yield pa.RecordBatch.from_arrays([pa.array(d2), pa.array(p2), pa.array(k2), pa.array(np.arange(len(d2)) >= flags)], ["d", "place", "k", "examine"])

    return map_arrow(rows.repartition("k").sortWithinPartitions("k", "s", "t", "d", "place"), run, "d long, place long, k long, examine boolean")


def _once(b, tail):
    """A sorted batch without rows equal to the one before, tail being the last of the batch before; and its own last one.
    Rows of a table that share an id and the text give such rows, which count as one."""
    import pyarrow as pa

    if not b.num_rows:
        return b, tail
    k, d, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    same = np.append(tail is not None and tail[:3] == (k[0], d[0], place[0]), (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (place[1:] == place[:-1]))
    body = b.column(3)
    for i in np.flatnonzero(same).tolist():
        same[i] = body[i].as_py() == (body[i - 1].as_py() if i else tail[3])
    last = (k[-1], d[-1], place[-1], body[len(k) - 1].as_py())
    return (b.filter(pa.array(~same)) if same.any() else b), last


class Shard:
    """Stretches in the order in which their windows count as earlier: the bytes, each stretch followed by a byte that no
    text has, with its document, place and end. Beyond HELD bytes they stay in unnamed files."""

    def __init__(self):
        self.text, self.d, self.place, self.end = Spool("u1"), Spool("<i8"), Spool("<i8"), Spool("<i8")

    def add(self, d: np.ndarray, place: np.ndarray, data: np.ndarray, size: np.ndarray) -> None:
        """Some stretches; data has their bytes one after the other."""
        ends = np.cumsum(size + 1) - 1
        text = np.full(len(data) + len(size), 255, np.uint8)
        letters = np.ones(len(text), bool)
        letters[ends] = False
        text[letters] = data
        self.end.add(ends + self.text.n)
        self.text.add(text)
        self.d.add(d)
        self.place.add(place)

    def parts(self) -> list[np.ndarray]:
        small = self.text.n <= HELD
        return [np.array(x.whole()) if small else x.whole() for x in (self.text, self.d, self.place, self.end)]


def repeated(text: np.ndarray, end: np.ndarray, window: int, memory: int = IN_MEMORY) -> np.ndarray:
    """For each byte of a shard's text, whether a window starts there that also starts earlier; in a file where text is."""
    n = len(text)
    if isinstance(text, np.memmap):
        zeros = Spool("?")
        for a in range(0, n, 1 << 20):
            zeros.add(np.zeros(min(n - a, 1 << 20), bool))
        marked = zeros.whole()
    else:
        marked = np.zeros(n, bool)
    rest = np.zeros(0, np.int64)  # of the group of equal windows that the last block ended in: its least place
    for at, shared in suffixes(text, window, memory):
        new = shared < window
        if len(rest):
            at, new = np.concatenate([rest, at]), np.concatenate([[True], new])
        new[0] = True
        several = np.flatnonzero(~(new & np.append(new[1:], False)))  # the last one's group may go on
        at, new = at[several], new[several]
        if len(at):
            j = np.searchsorted(end, at, side="right")
            whole = (j < len(end)) & (at + window <= end[np.minimum(j, len(end) - 1)])
            whole &= (j == 0) | (end[np.maximum(j, 1) - 1] != at)
            at = np.where(whole, at, n)
            first = np.flatnonzero(new)
            least = np.minimum.reduceat(at, first)
            twice = (at > least[np.cumsum(new) - 1]) & (at < n)
            marked[at[twice]] = True
            # The group may go on with windows that count; where nothing of it counts so far, a place has to stand for it.
            rest = least[-1:] if least[-1] < n else np.array([n - 1])
        else:
            rest = np.zeros(0, np.int64)
    return marked


def repeated_in(pieces: list[bytes], window: int, memory: int = IN_MEMORY) -> list[np.ndarray]:
    """For each piece the starts of its windows that also stand earlier: in a piece before, or before in the same one."""
    shard, size = Shard(), np.array([len(p) for p in pieces])
    shard.add(np.arange(len(size)), np.arange(len(size)), np.frombuffer(b"".join(pieces), np.uint8), size)
    text, _, _, end = shard.parts()
    marked = repeated(text, end, window, memory)
    return [np.flatnonzero(marked[e - n : e]) for n, e in zip(size.tolist(), end.tolist())]


def parted_again(piece: bytes, seed: int, window: int):
    """(second seed, start, size) of the parts of a hot seed's stretch: the least hash of each window but the seed itself is
    its second seed, which equal windows share too; neighbouring windows of one second seed stay together."""
    grams = _grams(np.frombuffer(piece, np.uint8))
    grams = np.where(grams.view(np.int64) == seed, np.uint64(2**64 - 1), grams)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1).min(axis=1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    size = np.append(first[1:], len(least)) - first + window - 1
    return zip(mix(least[first] ^ np.uint64(seed & (2**64 - 1))).view(np.int64).tolist(), first.tolist(), size.tolist())


def repeated_ranges(docs: DataFrame, window: int = 100) -> DataFrame:
    """docs (d long, text) to (d, ranges array<struct<start, size>>): byte ranges that are covered by windows which also
    start earlier. Documents without any are left out."""

    def parted(batches):
        import pyarrow as pa

        for b in batches:
            d = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(b.column(1))
            parts = []
            for i, part, off, a in _segments(raw, offsets, window):
                row, k, s, t, start, size = _stretches(part, off, window)
                parts.append((k, s, t, d[i + row], _pack(start + a, size)))
            if parts:
                out = _collapse(*(np.concatenate(x) for x in zip(*parts)))
                for m in range(0, len(out[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[m : m + 200_000]) for x in out], _NAMES)

    def written(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts, wanted = b.column(0).to_pylist(), b.column(1), b.column(2)
            d, k, place, body = [], [], [], []
            for i, number in enumerate(ids):
                data = texts[i].as_py().encode()
                for x in wanted[i].as_py():
                    start, size = x["place"] >> _LEN_BITS, x["place"] & (TWICE - 1)
                    piece = data[start : start + size]
                    if len(piece) != size:
                        continue
                    for seed, a, n in parted_again(piece, x["k"], window) if x["hot"] else [(x["k"], 0, size)]:
                        d.append(number)
                        k.append(seed)
                        place.append(((start + a) << _LEN_BITS) | n)
                        body.append(piece[a : a + n])
                if len(body) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(place, pa.int64()), pa.array(body, pa.binary())], ["k", "d", "place", "body"])
                    d, k, place, body = [], [], [], []
            if body:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), pa.array(place, pa.int64()), pa.array(body, pa.binary())], ["k", "d", "place", "body"])

    def searched(batches):
        import pyarrow as pa

        def found(shard):
            text, d, place, end = shard.parts()
            marked = repeated(text, end, window)
            edges, step = [], 1 << 20
            for a in range(0, len(marked), step):  # windows end before separators, so marks never run across stretches
                part = np.flatnonzero(marked[a : a + step]) + a
                if len(part):
                    edges.append(part)
            if not edges:
                return
            at = np.concatenate(edges)
            begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            ends = np.append(begins[1:], len(at)) - 1
            for m in range(0, len(begins), 100_000):
                a, e = at[begins[m : m + 100_000]], at[ends[m : m + 100_000]]
                j = np.searchsorted(end, a, side="right")
                start = np.where(j > 0, end[np.maximum(j, 1) - 1] + 1, 0)
                yield pa.RecordBatch.from_arrays([pa.array(d[j]), pa.array((place[j] >> _LEN_BITS) + a - start), pa.array(e - a + window)], ["d", "start", "size"])

        shard, last, tail = Shard(), None, None
        for b in batches:
            b, tail = _once(b, tail)
            if not b.num_rows:
                continue
            k, d, place = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            body = b.column(3).cast(pa.large_binary())
            _, offsets, data = body.buffers()
            off = np.frombuffer(offsets, np.int64, len(body) + 1, body.offset * 8)
            raw, cuts = np.frombuffer(data, np.uint8), [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            i = 0
            for j, e in zip(cuts, cuts[1:]):  # a seed stays in one shard
                if shard.text.n + off[j] - off[i] >= SHARD and (j > i or k[j] != last):
                    if j > i:
                        shard.add(d[i:j], place[i:j], raw[off[i] : off[j]], np.diff(off[i : j + 1]))
                    yield from found(shard)
                    shard, i = Shard(), j
            shard.add(d[i:], place[i:], raw[off[i] : off[-1]], np.diff(off[i:]))
            last = k[-1]
        if shard.text.n:
            yield from found(shard)

    settled = stored(_settle(map_arrow(docs.where(F.octet_length("text") >= window), parted, _SCHEMA)))
    look = settled.where("examine")
    hot = stored(look.groupBy("k").count().where(F.col("count") > HOT).select("k", F.lit(True).alias("hot")))
    look = look.join(F.broadcast(hot) if hot.count() <= FEW_HOT else hot, "k", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    close = look.groupBy("d").agg(F.collect_list(F.struct("k", "place", "hot")).alias("wanted"))
    texts = docs.join(close, "d").select("d", "text", "wanted")
    pieces = map_arrow(texts, written, "k long, d long, place long, body binary")
    near = map_arrow(pieces.repartition("k").sortWithinPartitions("k", "d", "place", "body"), searched, "d long, start long, size long")
    far = settled.where("not examine").select("d", F.shiftright("place", _LEN_BITS).alias("start"), F.col("place").bitwiseAND(TWICE - 1).alias("size"))
    return far.unionByName(near).groupBy("d").agg(F.collect_list(F.struct("start", "size")).alias("ranges"))


def remove_repeated_bytes(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """Per row of docs: the id, n_bytes, n_removed, n_spans, kept_sha256, and with with_bytes also kept, the bytes left.

    Texts are UTF-8 bytes. A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a document
    with a smaller id, or before in the same one; strings are judged on the input, may overlap and never cross
    documents. n_spans counts the maximal removed runs.

    The id is an integer. Rows with a null id have no place in the order: they lose nothing and take nothing away. Rows
    that share an id and the text lose the same; rows that share an id only count as one document whose windows stand at
    their places in either. Null texts are empty. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"))
    ranges = repeated_ranges(base.where("d is not null and text is not null").select("d", "text"), window)
    both = base.join(ranges, "d", "left").select("_id", "text", "ranges")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(b.column(1), b.column(2)):
                data = (text.as_py() or "").encode()
                kept, spans = [], 0
                at = 0
                if found.is_valid:
                    start, size = (np.asarray(found.values.field(i)) for i in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], (start + size)[order]
                    until = np.maximum.accumulate(end)
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > until[:-1]]))
                    for a, e in zip(start[new].tolist(), until[np.append(new[1:], len(until)) - 1].tolist()):
                        kept.append(data[at:a])
                        at, spans = e, spans + 1
                kept.append(data[at:])
                left = b"".join(kept)
                for x, y in zip(out, (len(data), len(data) - len(left), spans, sha256(left).hexdigest(), left)):
                    x.append(y)
            made = [b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(made + [pa.array(out[4], pa.binary())] * with_bytes, [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes)

    return map_arrow(both, run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
