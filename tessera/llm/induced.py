"""External induced sorting of suffixes with their common-prefix values, to a bounded depth.

The suffixes of a text fall into L and S types; those of S type behind one of L type (LMS) split the text into
substrings. Sorted and named, these make a reduced text of at most half the length, whose suffixes are sorted first, by
the same method, until a reduced text fits into the memory that is given and is sorted there by doubling. From them all
other suffixes are induced: first the L types by rising, then the S types by falling order. A tuple is a position and the
length of the prefix that it shares with the tuple before it. That value is carried along: what two neighbours of the
reduced text share in names tells where the comparison of the substrings behind goes on, and what is induced shares one
character more than the least value scanned since its neighbour was induced.

The priority queue that the induction runs on lies on disk beyond its share of memory. For bytes it has one
first-in-first-out lane for each first byte, since what is induced from sorted suffixes arrives in each lane already
sorted (``Lane``). Reduced texts have any number of characters; theirs is a heap that sheds its larger half into sorted
runs (``Heap``). Names are given by external sorting (``merged``). Texts, positions and names of levels that don't fit lie
in files that are mapped and read in blocks.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Tuples handled at once, and bytes of tuples that all lanes of a sorter keep in memory.
BLOCK, IN_MEMORY = 1 << 16, 64_000_000
#: Bytes that sorting a reduced text in memory takes for each of its characters.
EACH = 64
_TUPLE = np.dtype([("at", "<i8"), ("shared", "u1")])
#: For a character to which nothing was pushed yet, or only the text's last one before anything was scanned.
NEVER, AT_START = -1, -2


class Spool:
    """Fixed-size records on disk, appended in blocks and mapped afterwards; the file goes with the process."""

    def __init__(self, kind):
        self.kind, self.file, self.n = np.dtype(kind), tempfile.TemporaryFile(), 0

    def add(self, block: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(block, self.kind).tobytes())
        self.n += len(block)

    def whole(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.kind, "r+", shape=(self.n,)) if self.n else np.zeros(0, self.kind)


def blocks(n: int, size: int | None = None) -> Iterator[tuple[int, int]]:
    size = size or BLOCK
    for a in range(0, n, size):
        yield a, min(n, a + size)


def merged(parts: Iterable[np.ndarray], kind: np.dtype, keys: list[str], memory: int) -> Iterator[np.ndarray]:
    """Records in the order of their keys, in blocks: runs as large as memory allows are sorted and written, then merged."""
    order = lambda x: np.lexsort([x[k] for k in reversed(keys)])
    runs, held, size = [], [], 0

    def flush():
        nonlocal held, size
        x = np.concatenate(held)
        s = Spool(kind)
        s.add(x[order(x)])
        runs.append(s.whole())
        held, size = [], 0

    for part in parts:
        held.append(part)
        size += part.nbytes
        if size * 3 > memory and size > 64 * kind.itemsize:
            flush()
    if not runs:
        if held:
            x = np.concatenate(held)
            yield x[order(x)]
        return
    if held:
        flush()
    width = max(16, min(BLOCK, memory // (4 * kind.itemsize * len(runs))))
    at = [0] * len(runs)
    while any(i < len(r) for i, r in zip(at, runs)):
        # Up to the least of the runs' last records in sight everything is in sight.
        heads = [np.array(r[i : i + width]) for i, r in zip(at, runs)]
        more = [h for h, i, r in zip(heads, at, runs) if i + width < len(r)]
        bound = min((tuple(h[-1][k] for k in keys) for h in more), default=None)
        out = []
        for j, h in enumerate(heads):
            n = len(h) if bound is None else _upto(h, keys, bound)
            out.append(h[:n])
            at[j] += n
        x = np.concatenate(out)
        yield x[order(x)]


def _upto(sorted_: np.ndarray, keys: list[str], bound: tuple) -> int:
    """How many of some sorted records are at most bound."""
    lo, hi = 0, len(sorted_)
    for k, v in zip(keys, bound):
        left, right = (int(np.searchsorted(sorted_[k][lo:hi], v, side)) + lo for side in ("left", "right"))
        if k == keys[-1]:
            return right
        lo, hi = left, right
        if lo == hi:
            return lo
    return hi


class Heap:
    """A priority queue of (key, position, shared): the least key leaves first. Beyond ``most`` entries the larger half goes
    to a sorted run on disk, of which a few entries are in memory at a time."""

    KIND = np.dtype([("key", "<i8"), ("seq", "<i8"), ("at", "<i8"), ("shared", "<i4")])

    def __init__(self, most: int):
        self.most, self.near, self.heads, self.runs = max(32, most), [], [], []

    def push(self, key: int, seq: int, at: int, shared: int) -> None:
        heapq.heappush(self.near, (key, seq, at, shared))
        if len(self.near) > self.most:
            self.near.sort()
            half = len(self.near) // 2
            run = Spool(self.KIND)
            run.add(np.array(self.near[half:], self.KIND))
            del self.near[half:]
            self.runs.append(self._read(run.whole()))
            self._advance(len(self.runs) - 1)

    def _read(self, run: np.ndarray) -> Iterator[tuple]:
        for a, b in blocks(len(run), 8):  # there can be many runs
            yield from run[a:b].tolist()

    def _advance(self, i: int) -> None:
        head = next(self.runs[i], None)
        if head is not None:
            heapq.heappush(self.heads, (*head, i))

    def key(self) -> int | None:
        """The least key, None where nothing is left."""
        if self.heads and (not self.near or self.heads[0][:2] < self.near[0][:2]):
            return self.heads[0][0]
        return self.near[0][0] if self.near else None

    def pop(self) -> tuple[int, int, int, int]:
        if self.heads and (not self.near or self.heads[0][:2] < self.near[0][:2]):
            *entry, i = heapq.heappop(self.heads)
            self._advance(i)
            return tuple(entry)
        return heapq.heappop(self.near)


class Store:
    """Where lanes put blocks: memory up to a bound, then an unnamed file that goes with the process."""

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.used, self.file = most, 0, None

    def put(self, block: np.ndarray):
        if self.used + block.nbytes <= self.most:
            self.used += block.nbytes
            return block
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        place = self.file.tell()
        self.file.write(block.tobytes())
        return place, len(block)

    def get(self, kept) -> np.ndarray:
        if isinstance(kept, np.ndarray):
            self.used -= kept.nbytes
            return kept
        self.file.seek(kept[0])
        return np.frombuffer(self.file.read(kept[1] * _TUPLE.itemsize), _TUPLE)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Lane:
    """A queue of tuples that leave in the order in which they came, or all of them from the end. Short pushes are put
    together before they are stored."""

    def __init__(self, store: Store):
        self.store, self.blocks, self.tail, self.n = store, [], [], 0

    def push(self, at: np.ndarray, shared: np.ndarray) -> None:
        for k in range(0, len(at), BLOCK):
            b = np.empty(len(at[k : k + BLOCK]), _TUPLE)
            b["at"], b["shared"] = at[k : k + BLOCK], shared[k : k + BLOCK]
            self.tail.append(b)
            self.n += len(b)
            if self.n >= BLOCK // 16:
                self.flush()

    def flush(self) -> None:
        if self.tail:
            self.blocks.append(self.store.put(np.concatenate(self.tail) if len(self.tail) > 1 else self.tail[0]))
            self.tail, self.n = [], 0

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block by block, those included that are pushed meanwhile; small ones together."""
        while self.blocks or self.tail:
            held, n = [], 0
            while (self.blocks or self.tail) and n < BLOCK:
                if not self.blocks:
                    self.flush()
                held.append(self.store.get(self.blocks.pop(0)))
                n += len(held[-1])
            b = np.concatenate(held) if len(held) > 1 else held[0]
            yield b["at"].copy(), b["shared"].copy()

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """From the last tuple to the first; shared is then with the tuple that came before it this way."""
        after = 0
        self.flush()
        while self.blocks:
            b = self.store.get(self.blocks.pop())
            shared = np.append(b["shared"][1:], after).astype(np.uint8)
            after = b["shared"][0]
            yield b["at"][::-1].copy(), shared[::-1].copy()


class Ranges:
    """Minima of any ranges of a short array, from a table of all power-of-two lengths."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            prior, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(prior[:-half], prior[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over a <= i < b, none empty."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.uint8)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.levels[k][a[m]], self.levels[k][b[m] - 2**k])
        return out


def kinds(text: np.ndarray, behind: tuple[int, bool] | None = None) -> np.ndarray:
    """True for S types: smaller than the suffix behind. behind: the character after the text and its type; otherwise the
    end, which counts as smaller than any character."""
    n = len(text)
    whole = text if behind is None else np.append(text, np.asarray(behind[0], text.dtype))
    differ = np.flatnonzero(whole[:-1] != whole[1:])
    out = np.zeros(n, bool) if behind is None else np.full(n, behind[1])
    if len(differ):
        rises = whole[differ] < whole[differ + 1]
        place = np.searchsorted(differ, np.arange(n))
        inside = place < len(differ)
        out[inside] = rises[place[inside]]
    return out


def lms_of(text: np.ndarray) -> np.ndarray:
    """The LMS positions of a text, rising; in a file where the text is mapped."""
    if not isinstance(text, np.memmap):
        rising = kinds(text)
        return np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    parts, behind, last = [], None, None  # from the end to the start; last: the type of the block's successor
    for a, b in reversed(list(blocks(len(text)))):
        t = np.array(text[a:b])
        rising = kinds(t, behind)
        follows = np.append(rising[1:], False if last is None else last)
        s = Spool("<i8")
        s.add(np.flatnonzero(follows & ~rising) + a + 1)
        parts.append(s)
        behind, last = (int(t[0]), bool(rising[0])), bool(rising[0])
    out = Spool("<i8")
    for s in reversed(parts):
        out.add(s.whole())
        s.file.close()
    return out.whole()


class Text(np.ndarray):
    """Bytes in memory with the eight bytes from each place on at hand (``eights``): the end counts as 0, what is behind as
    0xFF."""

    eights = None

    @classmethod
    def of(cls, raw: np.ndarray) -> Text:
        padded = np.concatenate([raw, [0], np.full(8, 255)]).astype(np.uint8)
        out = padded[: len(raw)].view(cls)
        out.eights = np.ndarray((len(raw) + 1,), ">u8", padded, strides=(1,))
        return out


def _words(text: np.ndarray, at: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
    """Eight bytes from each place as one integer that sorts as they do; the end counts as 0, what is behind
    length as 0xFF."""
    place, n = np.minimum(at, len(text)), len(text)
    if (eights := getattr(text, "eights", None)) is not None:
        out = eights[place].astype(np.uint64)
    else:
        out = np.zeros(len(at), np.uint64)
        for j in range(8):
            b = np.where(place + j < n, text[np.minimum(place + j, n - 1)], np.where(place + j == n, 0, 255))
            out = (out << np.uint64(8)) | b.astype(np.uint64)
    if length is not None:
        short = np.flatnonzero(length < 8)
        left = np.maximum(length[short], 0).astype(np.uint64)
        rest = np.where(left > 0, np.uint64(2**64 - 1) >> (np.minimum(left, np.uint64(7)) * np.uint64(8)), np.uint64(2**64 - 1))
        out[short] |= rest
    return out


def _dense(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(differs)
    return rank


def _doubled(order: np.ndarray, differs: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a text, as deep as its first ``depth`` characters, by doubling, from that by their first
    character alone; differs tells where that changes. Only groups that aren't settled are sorted again."""
    n, order = len(order), order.copy()
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(differs, place, 0))
    alone = differs & np.append(differs[1:], True)
    going, step = place[~alone], 1
    while step < depth and len(going):
        at = order[going]
        behind = at + step
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[going] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, going, 0))
        going = going[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def _sorted_lms(text: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """The LMS positions of bytes in the order of their suffixes, to the depth: substrings named, then the reduced text
    sorted, all in memory."""
    n = len(lms)
    length = np.append(lms[1:], len(text)) - lms + 1
    rank = np.zeros(n, np.int64)
    j = 0
    while True:
        word = _words(text, lms + 8 * j, length - 8 * j)
        order = np.lexsort((word, rank))
        r, w = rank[order], word[order]
        differs = np.ones(n, bool)
        differs[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
        j += 1
        if 8 * j >= min(depth, length.max()) or differs.all():
            break
        rank = _dense(order, differs)
    return lms[_doubled(order, differs, (depth + 1) // 2 + 1)]  # each substring goes on by two bytes at least


def _compared(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Characters that the suffixes at a and at b share, cap at most; known of them are known to be equal."""
    if text.dtype == np.uint8:
        return known + shared_prefix(text, a + known, b + known, cap, known)
    out, going = known.copy(), np.flatnonzero(known < cap)
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        inside = np.maximum(x, y) < len(text)
        going, x, y = going[inside], x[inside], y[inside]
        going = going[text[x] == text[y]]
        out[going] += 1
        going = going[out[going] < cap]
    return out


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | int = 0) -> np.ndarray:
    """Bytes that the suffixes at a and at b share, cap less known at most."""
    out, cap = np.zeros(len(a), np.int64), np.broadcast_to(np.maximum(cap - known, 0), len(a))
    going = np.flatnonzero(cap > 0)
    while len(going):
        room = np.minimum(np.minimum(len(text) - a[going], len(text) - b[going]) - out[going], cap[going] - out[going])
        x = _words(text, a[going] + out[going]) ^ _words(text, b[going] + out[going])
        equal = np.full(len(going), 8, np.int64)
        some = x != 0
        # The highest bit that differs; halves first, as not every integer of 64 bits is exact as a double.
        high = (x >> np.uint64(32)).astype(np.float64)
        low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
        top = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        equal[some] = (64 - top[some]) // 8
        step = np.minimum(equal, np.maximum(room, 0))
        out[going] += step
        going = going[(step == 8) & (room > 8)]
    return out


def _names(text: np.ndarray, lms: np.ndarray, depth: int, memory: int) -> tuple[np.ndarray, int]:
    """The reduced text, in a file: each LMS substring's rank among all, equal ones alike, as deep as ``depth``; and how many
    ranks there are. A few characters at a time are sorted by what came before them and themselves."""
    n, wide = len(lms), 8 if text.dtype == np.uint8 else 1
    sorting = np.dtype([("rank", "<i8"), ("part", "<u8"), ("i", "<i8")])
    placing = np.dtype([("i", "<i8"), ("rank", "<i8")])
    longest = max(int((np.append(lms[a + 1 : b + 1], len(text))[: b - a] - lms[a:b]).max()) + 1 for a, b in blocks(n))
    ranks, j = None, 0
    while True:

        def parts():
            for a, b in blocks(n):
                at = np.array(lms[a:b])
                length = np.append(lms[a + 1 : b + 1], len(text))[: b - a] - at + 1
                x = np.empty(b - a, sorting)
                x["rank"], x["i"] = 0 if ranks is None else ranks[a:b], np.arange(a, b)
                if wide == 8:
                    x["part"] = _words(text, at + 8 * j, length - 8 * j)
                else:  # behind the substring the greatest value, behind the text the least
                    place = at + j
                    value = np.where(place < len(text), text[np.minimum(place, len(text) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
                    x["part"] = np.where(length <= j, np.uint64(2**64 - 1), value)
                yield x

        def placed():
            before, rank = None, 0
            for x in merged(parts(), sorting, ["rank", "part"], memory):
                new = np.ones(len(x), bool)
                new[1:] = (x["rank"][1:] != x["rank"][:-1]) | (x["part"][1:] != x["part"][:-1])
                new[0] = before is None or (x["rank"][0], x["part"][0]) != before
                out = np.empty(len(x), placing)
                out["i"], out["rank"] = x["i"], np.cumsum(new) + rank
                rank, before = int(out["rank"][-1]), (x["rank"][-1], x["part"][-1])
                found[0] = rank
                yield out

        found, spool = [0], Spool("<i8")
        for x in merged(placed(), placing, ["i"], memory):
            spool.add(x["rank"])
        ranks, j = spool.whole(), j + 1
        if wide * j >= min(depth, longest) or found[0] == n:
            return ranks, found[0]


def _lms_order(text: np.ndarray, lms: np.ndarray, depth: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (LMS positions, characters shared with the one before), rising. The reduced text is sorted by recursion
    unless it fits into memory."""
    n = len(lms)
    if n * EACH <= memory and text.dtype == np.uint8:
        order = _sorted_lms(text, lms, depth)
        for a, b in blocks(n):
            before = order[max(a - 1, 0) : b - 1 if a else b]
            near = shared_prefix(text, before, order[a:b], depth) if a else np.append(0, shared_prefix(text, order[: b - 1], order[1:b], depth))
            yield order[a:b], near
        return
    names, distinct = _names(text, lms, depth, memory)
    last = None
    for at, same in _reduced_order(names, distinct, depth, memory):
        here = np.array(lms[at])
        before = np.append(here[:1] if last is None else last, here[:-1])
        # So many whole substrings are equal: their bytes needn't be looked at again.
        known = np.minimum(np.where(at + same < n, lms[np.minimum(at + same, n - 1)], len(text)) - here, depth)
        near = _compared(text, before, here, known, depth)
        if last is None:
            near[0] = 0
        last = here[-1:]
        yield here, near


def _reduced_order(names: np.ndarray, distinct: int, depth: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, names shared with the one before) of all suffixes of a reduced text, rising."""
    n = len(names)
    if distinct == n:
        kind = np.dtype([("name", "<i8"), ("i", "<i8")])

        def parts():
            for a, b in blocks(n):
                x = np.empty(b - a, kind)
                x["name"], x["i"] = names[a:b], np.arange(a, b)
                yield x

        for x in merged(parts(), kind, ["name"], memory):
            yield x["i"], np.zeros(len(x), np.int64)
    elif n * EACH <= memory or n <= 64:
        text = np.array(names)
        order = np.argsort(text, kind="stable")
        differs = np.append(True, np.diff(text[order]) != 0)
        order = _doubled(order, differs, depth)
        near = np.append(0, _compared(text, order[:-1], order[1:], np.zeros(n - 1, np.int64), depth))
        for a, b in blocks(n):
            yield order[a:b], near[a:b]
    else:
        out = Spool(_TUPLE)
        for at, shared in _induced(names, distinct, depth, memory):
            x = np.empty(len(at), _TUPLE)
            x["at"], x["shared"] = at, shared
            out.add(x)
        found, after = out.whole(), 0
        for a, b in reversed(list(blocks(n))):
            x = np.array(found[a:b])[::-1]
            shared = np.append(after, x["shared"][:-1]).astype(np.int64)
            # falling order: a tuple's value is with the one before it, which comes behind it here
            after = int(x["shared"][-1])
            yield x["at"].astype(np.int64), shared


class _Since:
    """The least value since any of the latest tuples scanned; values are few, so the last place of each is enough."""

    def __init__(self, depth: int):
        self.last, self.now = [-1] * (depth + 1), -1

    def scan(self, shared: int) -> None:
        self.now += 1
        self.last[shared] = self.now

    def least(self, after: int) -> int:
        return next(v for v, at in enumerate(self.last) if at > after)


def _induced(text: np.ndarray, distinct: int, depth: int, memory: int) -> Iterator[tuple[list[int], list[int]]]:
    """Blocks of (positions, shared) of all suffixes of a text of integers, falling, by induction on a heap."""
    n, lms = len(text), lms_of(text)
    room = max(64, memory // 256)
    pushed = Spool("<i8")  # for each character when something was last pushed to it
    for a, b in blocks(distinct + 1):
        pushed.add(np.full(b - a, NEVER))
    pushed = pushed.whole()

    def seeds():
        for at, near in _lms_order(text, lms, depth, memory):
            yield from zip(text[at].tolist(), at.tolist(), near.tolist())

    def junction(x: int, y: int) -> int:
        return int(_compared(text, np.array([x]), np.array([y]), np.zeros(1, np.int64), depth)[0])

    def push(heap: Heap, since: _Since, char: int, key: int, at: int) -> None:
        before = int(pushed[char])
        shared = 0 if before == NEVER else min(1 + (since.least(before) if before != AT_START else 0), depth)
        pushed[char] = since.now
        heap.push(key, since.now, at, shared)

    # L types, by rising order
    heap, since, done = Heap(room), _Since(depth), Spool(_TUPLE)
    heap.push(int(text[n - 1]), -1, n - 1, 0)
    pushed[text[n - 1]] = AT_START
    held: list[tuple[int, int]] = []
    coming = seeds() if len(lms) else iter(())
    seed = next(coming, None)
    char, last, was_seed = -1, -1, False
    while (key := heap.key()) is not None or seed is not None:
        if seed is None or (key is not None and key <= seed[0]):
            key, _, at, shared = heap.pop()
            if key != char:
                char, shared = key, 0
            held.append((at, shared))
            if len(held) >= BLOCK:
                done.add(np.array(held, _TUPLE))
                held = []
            since.scan(shared)
            if at and (before := int(text[at - 1])) >= key:
                push(heap, since, before, before, at - 1)
            was_seed = False
        else:
            key, at, shared = seed
            if key != char:
                char, shared = key, 0
            elif not was_seed:
                shared = junction(last, at)
            since.scan(shared)
            before = int(text[at - 1])
            push(heap, since, before, before, at - 1)
            seed, was_seed = next(coming, None), True
        last = at
    if held:
        done.add(np.array(held, _TUPLE))

    # S types, by falling order; what is scanned is the result
    found = done.whole()
    pushed[:] = NEVER
    heap, since = Heap(room), _Since(depth)

    def falling():
        after = 0
        for a, b in reversed(list(blocks(len(found)))):
            x = np.array(found[a:b])[::-1]
            # with the tuple that comes before it this way
            shared = np.append(after, x["shared"][:-1]).astype(np.int64)
            after = int(x["shared"][-1])
            yield from zip(x["at"].tolist(), shared.tolist())

    coming = ((int(text[at]), at, shared) for at, shared in falling())
    large, char, last, fresh, out = next(coming, None), -1, -1, True, []
    while (key := heap.key()) is not None or large is not None:
        if large is None or (key is not None and -key >= large[0]):
            key, _, at, shared = heap.pop()
            key = -key
            if key != char:
                char, shared = key, 0
            fresh = True
            if at and (before := int(text[at - 1])) <= key:
                pre = before
            else:
                pre = -1
        else:
            key, at, shared = large
            if key != char:
                char, shared = key, 0
            elif fresh:
                shared = junction(last, at)
            fresh = False
            pre = int(text[at - 1]) if at and text[at - 1] < key else -1
            large = next(coming, None)
        since.scan(shared)
        out.append((at, shared))
        if len(out) >= BLOCK:
            yield [x for x, _ in out], [x for _, x in out]
            out = []
        if pre >= 0:
            push(heap, since, pre, -pre, at - 1)
        last = at
    if out:
        yield [x for x, _ in out], [x for _, x in out]


class _Pushes:
    """Sends what a scan induces to the lanes, with the prefix each shares with what came to the lane before it."""

    def __init__(self, lanes: list[Lane], cap: int):
        self.lanes, self.cap = lanes, cap
        self.since = np.zeros(256, np.uint8)  # least shared prefix scanned since the lane's last tuple

    def scan(self, shared: np.ndarray, which: np.ndarray, at: np.ndarray, byte: np.ndarray) -> None:
        """shared: of every tuple scanned; which: those that induce, to position at in lane byte."""
        ranges = Ranges(shared)
        upto = np.minimum.accumulate(shared)
        later = np.minimum(self.since, upto[-1])
        if len(which):
            order = np.argsort(byte, kind="stable")
            source, lane, place = which[order], byte[order], at[order]
            first = np.ones(len(source), bool)
            first[1:] = lane[1:] != lane[:-1]
            low = np.empty(len(source), np.uint8)
            low[first] = np.minimum(self.since[lane[first]], upto[source[first]])
            again = np.flatnonzero(~first)
            if len(again):
                low[again] = ranges.least(source[again - 1] + 1, source[again] + 1)
            new = np.minimum(low.astype(np.int64) + 1, self.cap).astype(np.uint8)
            begins = np.flatnonzero(first)
            ends = np.append(begins[1:], len(source))
            for s, e in zip(begins.tolist(), ends.tolist()):
                self.lanes[lane[s]].push(place[s:e], new[s:e])
            last = source[ends - 1]
            rest = np.full(len(last), 255, np.uint8)
            inner = last + 1 < len(shared)
            if inner.any():
                rest[inner] = ranges.least(last[inner] + 1, np.full(int(inner.sum()), len(shared)))
            later[lane[begins]] = rest
        self.since = later


def suffixes(text: np.ndarray, depth: int, in_memory: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, shared): all suffixes of a text of bytes by falling order of their first ``depth`` bytes, and
    the bytes that each shares with the one before it, ``depth`` at most. depth is 254 at most. The text may be mapped
    from a file; in_memory bounds what lanes, heaps and sorting hold, beside a few blocks."""
    if not 0 < depth <= 254:
        raise ValueError("a depth of 1 to 254")
    if not len(text):
        return
    text = text if isinstance(text, np.memmap) else Text.of(text)
    lms = lms_of(text)
    store = Store(in_memory)
    try:
        order = _lms_order(text, lms, depth, in_memory) if len(lms) else iter(())
        ahead: list[tuple[np.ndarray, np.ndarray]] = []

        def seeds(byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The LMS suffixes that start with a byte, rising; bytes are asked for in rising order."""
            while ahead or (block := next(order, None)) is not None:
                at, near = ahead.pop() if ahead else block
                if text[at[0]] > byte:
                    ahead.append((at, near))
                    return
                cut = int(np.searchsorted(text[at], byte, side="right"))
                if cut:
                    yield at[:cut], near[:cut]
                if cut < len(at):
                    ahead.append((at[cut:], near[cut:]))
                    return

        def junction(x: int, y: int) -> int:
            return int(shared_prefix(text, np.array([x]), np.array([y]), depth)[0])

        # L types, by rising order
        lanes, done = [Lane(store) for _ in range(256)], [Lane(store) for _ in range(256)]
        pushes = _Pushes(lanes, depth)
        lanes[text[-1]].push(np.array([len(text) - 1]), np.zeros(1, np.uint8))
        pushes.since[text[-1]] = 0
        for byte in range(256):
            last, fresh = -1, True
            for at, shared in lanes[byte].drain():
                if fresh:
                    shared[0], fresh = 0, False
                done[byte].push(at, shared)
                before = at - 1
                which = np.flatnonzero((before >= 0) & (text[before] >= byte))
                pushes.scan(shared, which, before[which], text[before[which]])
                last = int(at[-1])
            fresh = True
            for at, near in seeds(byte):
                shared = near.astype(np.uint8)
                if fresh:
                    shared[0], fresh = junction(last, int(at[0])) if last >= 0 else 0, False
                pushes.scan(shared, np.arange(len(at)), at - 1, text[at - 1])

        # S types, by falling order; what is scanned is the result
        lanes = [Lane(store) for _ in range(256)]
        pushes = _Pushes(lanes, depth)
        for byte in range(255, -1, -1):
            last, fresh = -1, True
            for at, shared in lanes[byte].drain():
                if fresh:
                    shared[0], fresh = 0, False
                before = at - 1
                which = np.flatnonzero((before >= 0) & (text[before] <= byte))
                pushes.scan(shared, which, before[which], text[before[which]])
                last = int(at[-1])
                yield at, shared
            fresh = True
            for at, shared in done[byte].backwards():
                if fresh:
                    shared[0], fresh = junction(last, int(at[0])) if last >= 0 else 0, False
                before = at - 1
                which = np.flatnonzero((before >= 0) & (text[before] < byte))
                pushes.scan(shared, which, before[which], text[before[which]])
                yield at, shared
    finally:
        store.close()
