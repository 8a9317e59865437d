"""SimHash near-duplicates, linked through the code words of a covering code.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 1 bit of their lower or of their upper half. In
each half the anchors are the words of the perfect Hamming code of length 31, whose covering radius is 1: every
fingerprint has one home anchor within 1 bit. A fingerprint is copied to every anchor within covering radius plus
threshold, 1 + 1 bits, of which there are at most 16 in a half. Of two fingerprints that differ in one bit of the half,
the second so always stands at the home anchor of the first, and only homes have to be compared with what stands at
their anchor. (Each half's 32nd bit takes no part in the anchors.)
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import then_none, map_arrow, mix, row_blocks, runs, sorted_groups, stored, text_bytes, with_column, word_hashes, words_of
from .components import components
from .packing import one_group_at_a_time

THRESHOLD = 3
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER_TABLE = np.frombuffer(_LOWER, np.uint8)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash over shingles of so many words, repeats included.

    A-Z are lower-cased, words are parted by ASCII white space. Each shingle, space-joined, is hashed by XXH64 with
    seed 42; a bit is 1 if it is set in over half of the hashes. Fewer words make one shingle, no words give 0.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - k + 1]
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), ends[k - 1 :][at : at + (1 << 16)].tolist())
        h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64)
        for i, byte in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            counts[8 * i : 8 * i + 8] += np.bincount(byte, minlength=256) @ _BITS
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: Sequence[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """The columns keep and fp (the fingerprint's 64 bits as a signed long) of each row; null texts count as empty."""
    keep = list(keep)
    names, at = with_column(keep, text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], [*keep, "fp"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_arrow(docs.select(*names), run, f"{kinds}fp long")


# ---------------------------------------------------------------- anchors


def _syndromes(block: np.ndarray, length: int) -> np.ndarray:
    """Of the lower bits, bit p - 1 standing at position p: the exclusive or of the positions set; 0 for code words."""
    out = np.zeros(len(block), np.uint64)
    for position in range(1, length + 1):
        out ^= ((block >> _U(position - 1)) & _U(1)) * _U(position)
    return out


def anchors(fp: np.ndarray, length: int = 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n fingerprints: for each copy its row, the anchor as one integer for all blocks, and whether it is at home.

    Blocks are of length + 1 bits, anchors the words of the perfect Hamming code of that length, 31 or 15. Of two
    fingerprints that differ in less than twice as many bits as there are blocks, some block differs in one at most.
    """
    rows, keys, homes = [], [], []
    flip = np.concatenate([[0], 1 << np.arange(length)]).astype(np.uint64)
    for side in range(64 // (length + 1)):
        block = (fp >> _U((length + 1) * side)) & _U((1 << length) - 1)
        s = _syndromes(block, length).astype(np.int64)
        tag = _U(side << 31)
        rows.append(np.arange(len(fp)))
        keys.append((block ^ flip[s]) | tag)
        homes.append(np.ones(len(fp), bool))
        away = np.flatnonzero(s)
        for i in range(1, length + 1):
            j = s[away] ^ i
            at = away[j > i]  # each pair of positions once; j is 0 where i alone is the home
            rows.append(at)
            keys.append((block[at] ^ flip[i] ^ flip[s[at] ^ i]) | tag)
            homes.append(np.zeros(len(at), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


#: Members of an anchor from which the other half's bytes part them first.
MANY = 2048


def forest(n: int, near) -> list[tuple[int, int]]:
    """Links among n members that keep together what is linked, each a pair that near, which gives the members that one
    links with, has told.

    Members outside the largest component are asked until none is left there unasked, so all pairs across components
    have been looked at, and a group that hangs together is settled by few of its members.
    """
    label, asked, out = np.arange(n), np.zeros(n, bool), []
    while True:
        counts = np.bincount(label, minlength=n)
        left = np.flatnonzero(~asked & (label != counts.argmax())) if asked.any() else np.arange(n)
        if not len(left):
            return out
        # any pair across components has a member outside the largest one; that one was or will be asked
        for i in left[:1].tolist() if n > 64 and len(left) == n else left.tolist():
            asked[i] = True
            met = near(i)
            roots, first = np.unique(label[met], return_index=True)
            other = roots != label[i]
            if other.any():
                out += [(i, int(x)) for x in met[first[other]]]
                label[np.isin(label, roots)] = min(int(roots[0]), int(label[i]))


def links_at(fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links between fingerprints, enough of them to keep together what is linked there."""
    pairs = forest(len(fp), lambda i: np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= threshold))
    return [(int(fp[a]), int(fp[b])) for a, b in pairs]


def _compared(batches, threshold: int, most: int):
    """(u, v, again) of a stream (key, fp, home) sorted by key: links, and the rows of groups of more than ``most``, their
    key and fingerprint as u and v, which have to be parted first."""
    import pyarrow as pa

    for now, starts, ends, large in sorted_groups(batches, 3, most):
        fp, home = now[1].view(np.uint64), now[2].astype(bool)
        homes = np.concatenate([[0], np.cumsum(home)])
        use = (ends - starts > 1) & (homes[ends] > homes[starts])
        starts, ends = starts[use], ends[use]
        pairs = ends - starts == 2
        a, b = fp[starts[pairs]], fp[starts[pairs] + 1]
        near = np.bitwise_count(a ^ b) <= threshold
        out = [np.stack([a[near], b[near]], 1)]
        found = [x for s, e in zip(starts[~pairs].tolist(), ends[~pairs].tolist()) for x in links_at(fp[s:e], threshold)]
        if found:
            out.append(np.array(found, np.uint64))
        link = np.concatenate(out).view(np.int64)
        over = [np.zeros((0, 2), np.int64), *(np.stack([now[0][s:e], now[1][s:e]], 1) for s, e in large)]
        both = np.concatenate([link, *over])
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(link))], ["u", "v", "again"])


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """fps (fp long, distinct) to (u, v): links of fingerprints that differ in at most threshold bits, enough of them
    that their connected components are those of all links. threshold is 3 at most.

    An anchor of more than MANY members isn't held: its rows are dealt once more, by anchor and each of the other half's
    four bytes, one of which two that differ in at most 3 bits share. What meets there is distinct and within 2 bits of
    the anchor, and is settled by asking few of its members."""
    if threshold > 3:
        raise ValueError("the halves' anchors hold for 3 differing bits at most")

    def copied(batches):
        import pyarrow as pa

        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 20_000):
                rows, keys, homes = anchors(fp[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[k : k + 20_000][rows].view(np.int64)), pa.array(homes)], ["anchor", "fp", "home"])

    many = MANY
    first = lambda batches: _compared(batches, threshold, many)
    second = lambda batches: _compared(batches, threshold, 1 << 62)
    spread = map_arrow(fps, copied, "anchor long, fp long, home boolean")
    found = stored(map_arrow(spread.repartition("anchor").sortWithinPartitions("anchor", "fp"), first, "u long, v long, again boolean"))
    # the anchor's tag says which half it is of; the bytes are those of the other one
    keys = F.array(*[F.xxhash64("u", F.lit(k), F.expr(f"shiftrightunsigned(v, {8 * k} + case when shiftright(u, 31) = 0 then 32 else 0 end) & 255")) for k in range(4)])
    parted = found.where("again").select(F.explode(keys).alias("anchor"), F.col("v").alias("fp"), F.lit(True).alias("home"))
    more = map_arrow(parted.repartition("anchor").sortWithinPartitions("anchor", "fp"), second, "u long, v long, again boolean")
    return found.where("not again").select("u", "v").unionByName(more.select("u", "v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: the id, the columns keep, fp (long) and component_id, the least id linked with it.

    Fingerprints link at threshold or fewer differing bits; equal ones always do. Null and empty texts have fingerprint
    0 and link as any other. Rows with a null id take part; their component_id is null only where no row of the
    component has an id. Repeated rows get the same values.

    Rows of one fingerprint are combined before anything is compared, so exact copies cost nothing more. Only distinct
    fingerprints are copied to anchors, only a forest of links leaves an anchor, and components are joins.
    """
    keep = [c for c in keep if c != id_col]
    if clash := {"fp", "component_id"} & {id_col, *keep}:
        raise ValueError(f"{clash} are columns of the result")
    base = stored(fingerprints(docs, [id_col, *keep], text_col, words))
    own = stored(base.groupBy("fp").agg(F.min(id_col).alias("_least")))
    by = own.join(_roots(own.select("fp"), threshold), "fp")
    roots = by.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = by.select("fp", "_root").join(roots, "_root").select("fp", "component_id")
    return base.join(named, "fp").select(id_col, *keep, "fp", "component_id")


def _roots(fps: DataFrame, threshold: int) -> DataFrame:
    """(fp, _root) for distinct fingerprints: the least fingerprint linked with each."""
    parts = components(links(fps, threshold))
    return fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", F.coalesce("root", "fp").alias("_root"))


# ---------------------------------------------------------------- texts of a given similarity, exactly

#: Words in a shingle, and half bytes of MinHash in the marks of a text.
SHINGLE, MINIMA = 5, 128
#: Texts are near-duplicates from OVER / UNDER of their shingles on. Bits of a parity sketch; shingles from which minima
#: count besides; how many of MINIMA must agree then: 104 do on average at 0.8, fewer than LOOSE once in 1e9.
OVER, UNDER = 4, 5
PARITY, LONG, LOOSE = 256, 360, 77
#: Texts that are looked at for common shingles, and in how many of them a shingle has to be. Buckets of so many members are
#: compared all at once.
SAMPLE, COMMON, FEW = 20_000, 20, 16
#: Members of a large bucket that are asked before it is compared block by block.
BLOCK = 64
#: Elements that are compared in one task, nodes that shares of larger groups have in common, and larger groups up to which
#: their list is sent to every executor.
TOGETHER, PIVOTS, FEW_LARGE = 250_000, 16, 50_000


def shingle_sets(column):
    """Blocks (first row, row after the last, hashes, offsets) of an Arrow column: each text's distinct five-word
    shingles, rising. Words are as in ``fingerprint``; fewer than five make one shingle, none make no shingle."""
    raw, offsets = text_bytes(column)
    for lo, hi in row_blocks(offsets, 500_000):
        part = _LOWER_TABLE[raw[offsets[lo] : offsets[hi]]]
        starts, ends, rows = words_of(part, offsets[lo : hi + 1] - offsets[lo])
        size = np.diff(rows)
        doc = np.repeat(np.arange(hi - lo), size)
        place = np.arange(len(starts)) - rows[doc]
        words, whole = word_hashes(part, starts, ends), np.flatnonzero(place + SHINGLE <= size[doc])
        found, where = [runs(words, whole, SHINGLE)], [doc[whole]]
        for n in range(1, SHINGLE):
            where.append(np.flatnonzero(size == n))
            found.append(runs(words, rows[where[-1]], n))
        h, doc = np.concatenate(found), np.concatenate(where)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[first], doc[first]
        yield lo, hi, h, np.searchsorted(doc, np.arange(hi - lo + 1))


def _marks(h: np.ndarray, doc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of each text: whether an even or odd number of its shingles falls to each of PARITY bits, so two texts differ in
    no more bits than shingles; and MINIMA half bytes, the least shingle of each part of their range, mixed."""
    n = len(size)
    odd = np.bincount(doc * PARITY + (h & _U(PARITY - 1)).astype(np.int64), minlength=n * PARITY) & 1
    parity = np.packbits(odd.reshape(n, PARITY).astype(np.uint8), axis=1)
    key = doc * MINIMA + (h >> _U(65 - MINIMA.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))  # hashes rise in each text, so the first of a part is its least
    half = np.zeros(n * MINIMA, np.uint8)
    half[key[first]] = (mix(h[first]) & _U(15)).astype(np.uint8)
    half = half.reshape(n, MINIMA)
    return np.concatenate([parity, half[:, ::2] << 4 | half[:, 1::2]], axis=1)


def set_fingerprints(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The SimHash of each set of shingles, as a signed long: a bit is 1 if it is set in over half of the hashes."""
    out, there = np.zeros(len(rows) - 1, np.int64), np.flatnonzero(np.diff(rows))
    if len(there):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, rows[:-1][there], axis=0, dtype=np.int32)
        out[there] = np.packbits(counts * 2 > np.diff(rows)[there, None], axis=1, bitorder="little").view(np.int64).ravel()
    return out


def prefixes(column, common: np.ndarray) -> list[tuple[int, int, bytes, bytes, bytes]]:
    """Of each text: the number of its shingles, their SimHash, a digest of the set, its marks, and the hashes of its prefix.

    In the order of rarity first, common shingles last, then by hash, the prefix is all but the last OVER / UNDER of the
    shingles, and one more. Of two sets that share so much of the larger one, the prefixes share a shingle.
    """
    out = []
    for lo, hi, h, rows in shingle_sets(column):
        size = np.diff(rows)
        doc = np.repeat(np.arange(hi - lo), size)
        marks, fps = _marks(h, doc, size), set_fingerprints(h, rows)
        digest = np.zeros((hi - lo, 2), np.uint64)
        there = np.flatnonzero(size)
        if len(there):
            for k in range(2):
                digest[there, k] = np.add.reduceat(mix(h ^ _U(k + 1)), rows[:-1][there])
        often = np.zeros(len(h), bool)
        if len(common):
            often = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = h[np.lexsort((h, often, doc))]
        length = np.where(size > 0, size - -(-OVER * size // UNDER) + 1, 0)
        out += [(int(n), int(fps[i]), digest[i].tobytes(), marks[i].tobytes(), h[a : a + k].tobytes()) for i, (n, a, k) in enumerate(zip(size, rows, length))]
    return out


def maybe_alike(size: np.ndarray, marks: np.ndarray, other_size: np.ndarray, other_marks: np.ndarray, i, j) -> np.ndarray:
    """Whether texts i and, of the others, j may share OVER / UNDER of their shingles: never false for texts of fewer than
    LONG that do."""
    a, b = size[i], other_size[j]
    near = UNDER * np.minimum(a, b) >= OVER * np.maximum(a, b)
    differ = marks[i] ^ other_marks[j]
    bits = np.bitwise_count(differ[..., : PARITY // 8]).sum(axis=-1, dtype=np.int64)
    minima = differ[..., PARITY // 8 :]
    agree = (minima >> 4 == 0).sum(axis=-1) + (minima & 15 == 0).sum(axis=-1)
    return near & (bits * (UNDER + OVER) <= (a + b) * (UNDER - OVER)) & ((np.minimum(a, b) < LONG) | (agree >= LOOSE))


def needed(a, b):
    """How many shingles sets of a and b of them have in common at OVER / UNDER."""
    return -(-OVER * (a + b) // (OVER + UNDER))


def may_meet(size: np.ndarray, place: np.ndarray, i, j) -> np.ndarray:
    """Whether texts i and j may be alike and meet by a shingle at these places of theirs, counted from 0 in the order of
    prefixes. Of two alike texts of a and b shingles the first a - needed + 1 of one and b - needed + 1 of the other share
    one; so they meet by some shingle of which this is true, and texts that hang on a pattern's shingles alone don't."""
    a, b = size[i], size[j]
    least = needed(a, b)
    return (place[i] <= a - least) & (place[j] <= b - least)


def _shared(nodes: DataFrame) -> DataFrame:
    """(shingle, node, place) of nodes (node, n, prefix): prefix shingles by which nodes may meet.

    A node may meet one that is no smaller by its first shingles only, a ninth of them; by the rest of its prefix it can only
    be met, by smaller ones. A shingle's rows come sorted, those of the first kind in front, so one pass that holds the range of
    their sizes tells which of the others can be met. A shingle that very many prefixes share, none of them in front, is
    let go of as it streams by."""

    def copied(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                part = b.slice(k, 2_000)
                held = part.column(2).to_pylist()
                length = np.array([len(x) // 8 for x in held], np.int64)
                row = np.repeat(np.arange(len(held)), length)
                place = np.arange(len(row)) - (np.cumsum(length) - length)[row]
                n = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                met = place > n - needed(n, n)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(held), np.int64)), part.column(0).take(take), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(met)], ["shingle", "node", "n", "place", "met"])

    def several(batches):
        import pyarrow as pa

        least, most, of = 1 << 40, -1, None
        for now, starts, ends, large in sorted_groups(batches, 5, MANY):
            n, met = now[2].astype(np.int64), now[4].astype(bool)
            keep = np.zeros(len(n), bool)
            if len(starts):
                low = np.minimum.reduceat(np.append(np.where(met, 1 << 40, n), 0), np.stack([starts, ends], 1).ravel())[::2]
                high = np.maximum.reduceat(np.append(np.where(met, -1, n), 0), np.stack([starts, ends], 1).ravel())[::2]
                size = ends - starts
                use = (size > 1) & (high >= 0)
                at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
                low, high, use = (np.repeat(x, size) for x in (low, high, use))
                keep[at] = use & (~met[at] | ((n[at] >= low) & (OVER * n[at] <= UNDER * high)))
            for s, e in large:
                if now[0][s] != of:
                    least, most, of = 1 << 40, -1, now[0][s]
                front = n[s:e][~met[s:e]]
                if len(front):
                    least, most = min(least, int(front.min())), max(most, int(front.max()))
                keep[s:e] = ~met[s:e] | ((n[s:e] >= least) & (OVER * n[s:e] <= UNDER * most))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(now[i][keep]) for i in (0, 1, 3)], ["shingle", "node", "place"])

    spread = map_arrow(nodes.select("node", "n", "prefix"), copied, "shingle long, node long, n int, place int, met boolean")
    return map_arrow(spread.repartition("shingle").sortWithinPartitions("shingle", "met"), several, "shingle long, node long, place int")


def _marked(batches, columns: int):
    """The batches with their last column, marks, as a matrix of bytes."""
    for b in batches:
        raw = np.frombuffer(b"".join(b.column(columns - 1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        yield [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(columns - 1)), raw]


def _meeting(size: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The members of a bucket that may meet any other, in parts between which none may; sizes and places alone decide, so
    however many members are alike in both, they are judged once."""
    kind, of, count = np.unique(size << 32 | place, return_inverse=True, return_counts=True)
    n, at = kind >> 32, kind & 0xFFFFFFFF
    label, some = np.arange(len(kind)), np.zeros(len(kind), bool)
    for i in range(len(kind)):
        last = int(np.searchsorted(n, UNDER * n[i] // OVER, side="right"))
        j = np.arange(i, last)
        j = j[may_meet(n, at, i, j)]
        if count[i] == 1:
            j = j[j > i]
        if len(j):
            some[i] = some[j] = True
            found = np.unique(label[np.append(j, i)])
            label[np.isin(label, found)] = found[0]
    part = np.where(some, label, -1)[of]
    return [np.flatnonzero(part == x) for x in np.unique(part[part >= 0])]


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """rows (shingle long, node long, place int, n int, marks binary) to (u, v): pairs that meet by a shingle (``may_meet``) and
    may be alike, enough of them to keep together what hangs together by such pairs; in buckets of up to FEW members all
    of them.

    Larger buckets are first parted by what may meet at all. Parts of more than MANY members, in which asking BLOCK of them
    hasn't left few, are compared block by block in a second stage, so a task compares MANY members with MANY others."""

    def closed(batches):
        """Whole buckets: the pieces of one that goes on are put together once, when it ends."""
        open_: list[list[np.ndarray]] = []
        for now in then_none(_marked(batches, 5)):
            if now is not None and not len(now[0]):
                continue
            if now is None:
                if open_:
                    yield [np.concatenate(x) for x in zip(*open_)]
                return
            last = int(np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1]))[-1])
            if open_ and now[0][0] != open_[0][0][0]:
                yield [np.concatenate(x) for x in zip(*open_)]
                open_ = []
            if last or not open_:
                if last:
                    whole = [x[:last] for x in now]
                    yield [np.concatenate(x) for x in zip(*open_, whole)] if open_ else whole
                open_ = [[x[last:] for x in now]]
            else:
                open_.append(now)

    def compared(batches):
        import pyarrow as pa

        for key, node, place, size, marks in closed(batches):
            size, place = size.astype(np.int64), place.astype(np.int64)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(starts[1:], len(key))
            few = ends - starts <= FEW
            until = np.repeat(np.where(few, ends, 0), ends - starts)  # of members of small buckets: where the bucket ends
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, FEW):
                i = np.flatnonzero(np.arange(len(key)) + d < until)
                for k in range(0, len(i), 1 << 18):
                    x = i[k : k + (1 << 18)]
                    x = x[may_meet(size, place, x, x + d)]
                    x = x[maybe_alike(size, marks, size, marks, x, x + d)]
                    us.append(node[x])
                    vs.append(node[x + d])
            again: list[np.ndarray] = []
            for s, e in zip(starts[~few].tolist(), ends[~few].tolist()):
                for part in _meeting(size[s:e], place[s:e]):
                    at = s + part
                    pairs, left = _hanging(size[at], place[at], marks[at], MANY, BLOCK)
                    us.append(node[at[pairs[:, 0]]])
                    vs.append(node[at[pairs[:, 1]]])
                    if len(left):
                        ask = np.zeros(len(at), bool)
                        ask[left] = True
                        again += _blocks(int(key[s]) ^ int(part[0]) * 0x9E3779B9, at, ask, MANY)
            pair = _pairs(np.concatenate(us), np.concatenate(vs))
            yield pa.RecordBatch.from_arrays([*pair.columns, *(pa.nulls(pair.num_rows, t) for t in (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()))], _AGAIN)
            for block, at, ask in again:
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.nulls(n, pa.int64()), pa.array(np.full(n, block)), pa.array(ask), pa.array(place[at].astype(np.int32)), pa.array(size[at].astype(np.int32)), pa.array([m.tobytes() for m in marks[at]], pa.binary())],
                    _AGAIN,
                )

    def blocks(batches):
        def at(held):
            import pyarrow as pa

            t = pa.Table.from_batches(held)
            node, ask, place, size = (t.column(c).to_numpy() for c in ("u", "ask", "place", "n"))
            marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(len(node), -1)
            size, place, ask = size.astype(np.int64), place.astype(np.int64), ask.astype(bool)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            label = np.arange(len(node))
            for i in np.flatnonzero(ask).tolist():
                met = _near(size, place, marks, i)
                roots, first = np.unique(label[met], return_index=True)
                other = roots != label[i]
                vs.append(node[met[first[other]]])
                us.append(np.full(len(vs[-1]), node[i]))
                if other.any():
                    label[np.isin(label, roots)] = min(int(roots[0]), int(label[i]))
            yield _pairs(np.concatenate(us), np.concatenate(vs))

        yield from one_group_at_a_time(batches, "block", at)

    found = stored(map_arrow(rows.repartition("shingle").sortWithinPartitions("shingle", "node"), compared, "u long, v long, block long, ask boolean, place int, n int, marks binary"))
    more = found.where("block is not null").select("block", "u", "ask", "place", "n", "marks")
    more = map_arrow(more.repartition("block").sortWithinPartitions("block"), blocks, "u long, v long")
    return found.where("block is null").select("u", "v").unionByName(more).distinct()


_AGAIN = ["u", "v", "block", "ask", "place", "n", "marks"]


def _near(size: np.ndarray, place: np.ndarray, marks: np.ndarray, i: int) -> np.ndarray:
    """The members that member i meets and may be like."""
    met = np.flatnonzero(may_meet(size, place, i, slice(None)))
    return met[maybe_alike(size, marks, size, marks, i, met)]


def _hanging(size: np.ndarray, place: np.ndarray, marks: np.ndarray, many: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, left) of a part of a bucket: links keep together what hangs together but for what the members left, none if
    the part has up to many, would still add, which as many as first have been asked for."""
    n = len(size)
    if n <= many:
        return np.array(forest(n, lambda i: _near(size, place, marks, i)), np.int64).reshape(-1, 2), np.zeros(0, np.int64)
    label, asked, links = np.arange(n), np.zeros(n, bool), []
    for _ in range(first):
        counts = np.bincount(label, minlength=n)
        main = counts.argmax() if asked.any() else -1
        left = np.flatnonzero(~asked & (label != main))
        if not len(left):
            break
        i = int(left[len(left) // 2])
        asked[i] = True
        met = _near(size, place, marks, i)
        roots, first = np.unique(label[met], return_index=True)
        other = roots != label[i]
        links += [(i, int(x)) for x in met[first[other]]]
        if other.any():
            label[np.isin(label, roots)] = min(int(roots[0]), int(label[i]))
    return np.array(links, np.int64).reshape(-1, 2), np.flatnonzero(~asked & (label != np.bincount(label, minlength=n).argmax()))


def _blocks(salt: int, at: np.ndarray, ask: np.ndarray, many: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block, members, which of them are asked): every member to be asked meets every other member once."""
    asked, out = np.flatnonzero(ask), []
    for i in range(0, len(asked), many):
        for j in range(0, len(at), many):
            mine = asked[i : i + many]
            others = np.setdiff1d(np.arange(j, min(j + many, len(at))), mine)
            both = np.concatenate([mine, others])
            out.append(((salt + i * 1_000_003 + j) & 0x7FFFFFFFFFFFFFFF, at[both], np.arange(len(both)) < len(mine)))
    return out


def _pairs(u: np.ndarray, v: np.ndarray):
    import pyarrow as pa

    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    pair = pair[pair[:, 0] != pair[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["u", "v"])


def _hashed(texts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns keep, of numbers, and hashes, the distinct shingles of each text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, hi, h, rows in shingle_sets(b.column(len(keep))):
                held = [h[s:e].tobytes() for s, e in zip(rows, rows[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(held, pa.binary())], [*keep, "hashes"])

    return map_arrow(texts.select(*keep, "text"), run, ", ".join(f"{c} long" for c in keep) + ", hashes binary")


def _postings(sets: list[np.ndarray]):
    """near(i): the places of sets that share OVER / UNDER of their elements with set i, counted exactly."""
    size = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    values, owner = every[order], np.repeat(np.arange(len(sets)), size)[order]

    def near(i: int) -> np.ndarray:
        a, b = np.searchsorted(values, sets[i]), np.searchsorted(values, sets[i], side="right")
        n = b - a
        met = owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        shared = np.bincount(met, minlength=len(sets))
        return np.flatnonzero(shared * (UNDER + OVER) >= OVER * (size + size[i]))

    return near


def exact_links(rows: DataFrame) -> DataFrame:
    """rows (g long, node long, ask boolean, hashes binary) to (u, v): within each group g links between sets that share
    OVER / UNDER of their elements, enough of them to keep together what is linked with one that is to be asked. Rows of
    a group may repeat."""

    def run(batches):
        import pyarrow as pa

        def at(held):
            t = pa.Table.from_batches(held)
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)
            hashes, ask = t.column("hashes").to_pylist(), t.column("ask").to_numpy()
            asked = set(np.unique(t.column("node").to_numpy()[ask]).tolist())
            near = _postings([np.frombuffer(hashes[i], np.uint64) for i in first.tolist()])
            if len(asked) == len(node):
                links = forest(len(node), near)
            else:
                label = np.arange(len(node))
                links = []
                for i in (i for i in range(len(node)) if int(node[i]) in asked):
                    met = near(i)
                    roots, one = np.unique(label[met], return_index=True)
                    links += [(i, int(x)) for x in met[one[roots != label[i]]]]
                    label[np.isin(label, roots)] = min(int(roots[0]), int(label[i])) if len(roots) else label[i]
            pair = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[pair[:, 0]]), pa.array(node[pair[:, 1]])], ["u", "v"])

        yield from one_group_at_a_time(batches, "g", at)

    return map_arrow(rows.repartition("g").sortWithinPartitions("g"), run, "u long, v long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) by exact links: pairs (u, v) hang together what may be linked; nodes (node, n, number) have the number of
    a row of texts (number, text) and of its shingles.

    What hangs together is compared in one task where it has up to TOGETHER shingles. Larger groups are dealt into shares
    of that size, each compared by itself and with the PIVOTS first nodes of other shares, which join what hangs together
    across shares. Nodes that don't belong to the largest part then are a query set that is looked up, in blocks, against
    every share. So no task holds a group that isn't bounded, and no pairs but links leave one. The texts are sent once.
    """
    loose = stored(components(pairs).join(nodes, "node").select("node", "root", "n", "number"))
    total = loose.groupBy("root").agg(F.sum("n").alias("t")).where(F.col("t") > TOGETHER)
    large = stored(total.select("root", F.ceil(F.col("t") / TOGETHER).alias("shares")))
    n_large = large.count()
    whole = lambda *more: F.xxhash64("root", *more).alias("g")
    row = lambda df: df.select(whole("share"), "node", F.lit(True).alias("ask"), "hashes")
    dealt = loose.join(F.broadcast(large) if n_large <= FEW_LARGE else large, "root", "left") if n_large else loose.withColumn("shares", F.lit(1).cast("long"))
    dealt = dealt.withColumn("shares", F.coalesce("shares", F.lit(1).cast("long"))).withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")))
    keep = ["node", "root", "n", "shares", "share"]
    sets = _hashed(texts.join(dealt, "number"), keep)
    if not n_large:
        return components(exact_links(row(sets)))
    sets = stored(sets)
    dealt = sets.where("shares > 1")
    firsts = dealt.where(F.col("share") < PIVOTS).groupBy("root", "share").agg(F.min("node").alias("node")).select("node")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    pivots = dealt.join(firsts, "node", "left_semi").select("root", "node", "hashes", every)
    links = stored(exact_links(row(sets).unionByName(row(pivots))))
    tight = components(links).withColumnRenamed("root", "tight")
    of = stored(dealt.select("node", "root", "n").join(tight, "node", "left").select("node", "root", "n", F.coalesce("tight", "node").alias("tight")))
    main = of.groupBy("root", "tight").count().groupBy("root").agg(F.max_by("tight", F.struct("count", "tight")).alias("main"))
    left = stored(of.join(main, "root").where("tight <> main").select("node", "root", "n"))
    blocks = stored(left.groupBy("root").agg(F.ceil(F.sum("n") / TOGETHER).alias("blocks")))
    asked = dealt.join(left.select("node"), "node", "left_semi").join(blocks, "root")
    asked = asked.select("root", "node", "hashes", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").alias("block"), every)
    against = dealt.join(blocks, "root").select("root", "node", "hashes", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    named = lambda df, ask: df.select(whole("share", "block"), "node", F.lit(ask).alias("ask"), "hashes")
    more = exact_links(named(asked, True).unionByName(named(against, False)))
    return components(links.unionByName(more))


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that COMMON or more of about SAMPLE texts hold, rising. Only the order of prefixes depends on them, never
    what is found."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for _, _, h, _ in shingle_sets(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    texts = docs.select(F.col(f"`{text_col}`"))
    found = map_arrow(texts.sample(share, 1) if share < 1 else texts, run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r[0] for r in found.orderBy(F.desc("count"), "h").limit(200_000).collect()], np.int64).view(np.uint64))


def fingerprint_pairs(own: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """own (node, fp) to (u, v), u < v: nodes that hang together by fingerprints of at most threshold differing bits, each
    fingerprint standing for its least node."""
    least = stored(own.groupBy("fp").agg(F.min("node").alias("least")))
    same = own.join(least, "fp").where("node <> least").select("least", F.col("node").alias("other"))
    of = lambda c, out: least.select(F.col("fp").alias(c), F.col("least").alias(out))
    near = links(least.select("fp"), threshold).join(of("u", "least"), "u").join(of("v", "other"), "v").select("least", "other")
    return same.unionByName(near).select(F.least("least", "other").alias("u"), F.greatest("least", "other").alias("v"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the least id, the first of equal ones.

    Near-duplicates share 0.8 or more (Jaccard) of their distinct five-word shingles, or are linked by texts that do.
    Texts of one shingle set are combined. Candidates are, first, sets whose SimHash fingerprints link as those of operator 8
    do (``fingerprint_pairs``). Pairs at 0.8 often differ in more bits than the covering code reaches; so, second, those
    that share a shingle of their prefixes, as all pairs at 0.8 do, and pass a comparison of sizes and marks that no such pair fails (those of LONG or more shingles once in 1e9). Of what hangs
    together by candidates the shingle sets are compared exactly, in shares of bounded size (``verified``).

    Columns stay as they are. Rows with a null id come after all others, so one stays only where its group has no id.
    Null texts and those without words are one group. The rows are numbered and written to the shared folder; one join
    by number takes the rows that stay. Of a shingle by which very many texts meet, a task holds 112 bytes a node.
    """
    number, plain = "_tessera_row", list(docs.columns)
    text, key = plain.index(text_col), f"c{plain.index(id_col)}"
    common = common_shingles(docs, text_col)
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(plain)], F.monotonically_increasing_id().alias(number))
    base = stored(base)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, fp, digest, marks, prefix = zip(*prefixes(b.column(2), common)) if b.num_rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), *(pa.array(x, pa.binary()) for x in (digest, marks, prefix))], [number, "id", "n", "fp", "digest", "marks", "prefix"])

    kind = dict(base.dtypes)[key]
    sets = map_arrow(base.select(number, F.col(key).alias("id"), F.col(f"c{text}").alias("text")), run, f"{number} long, id {kind}, n int, fp long, digest binary, marks binary, prefix binary")
    first = F.min(F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col(number).alias("c"))).alias("_first")
    rest = [F.first(c).alias(c) for c in ("fp", "marks", "prefix")]
    own = stored(sets.groupBy("digest", "n").agg(first, *rest).withColumn("node", F.monotonically_increasing_id()))
    rows = stored(_shared(own).join(own.select("node", "n", "marks"), "node").select("shingle", "node", "place", "n", "marks"))
    pairs = stored(fingerprint_pairs(own).unionByName(bucket_pairs(rows)).distinct())
    nodes = own.select("node", F.col("n").cast("long").alias("n"), F.col("_first.c").alias("number"))
    parts = verified(pairs, nodes, base.select(F.col(number).alias("number"), F.col(f"c{text}").alias("text")))
    roots = own.select("node", "_first").join(parts, "node", "left").select(F.coalesce("root", "node").alias("_root"), "_first")
    stay = roots.groupBy("_root").agg(F.min("_first").alias("f")).select(F.col("f.c").alias(number))
    return base.join(stay, number, "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(plain)])


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id; see ``near_duplicates``."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
