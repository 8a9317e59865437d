"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and a closing id. Only documents longer than a sequence are cut. Pieces are dealt into
groups of bounded size, each packed by itself: best fit by falling length first, then a swap-based local search that
exchanges, two for one, one for one, or moves documents between underfull bins as long as the sum of squared fills
grows, until bins empty. A group that has thousands of pieces leaves about one bin underfull, so little is lost to the
dealing, and any number of groups can be packed at once.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from bisect import bisect_left, insort
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Pieces in one group, about.
GROUP = 4096


# ---------------------------------------------------------------- tokens


# Separators to Python only, and the letter whose small form depends on its place to Python only.
_ODD = re.compile("[\x1c-\x1f\u03a3]").search


def _byte_letters() -> dict[int, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable Latin-1 as itself, the others, in order, as
    the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _rules_part_at_spaces(path: str) -> bool:
    """Whether a tokenizers file's own rules keep words apart: its normaliser composes, makes white space one space and
    letters small, none of which looks past a space, and every piece that its pre-tokenizer's pattern can match is
    without white space, the rest being removed; letters that stand together are one piece."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    normal = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
    pattern = split.get("pattern", {}).get("Regex", "\\s").split("|")
    parts = all(re.fullmatch(r"'[a-z]+", p) or p in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") for p in pattern) and "[\\p{L}]+" in pattern
    return normal and parts and split.get("behavior") == "Removed" and split.get("invert") is True and not spec.get("post_processor")


class Words(dict):
    """Token ids of a text by a tokenizers file, word by word.

    The normaliser of such a file maps white space to one space and the pre-tokenizer never lets a token reach over
    it, so words between white space encode by themselves; each distinct word goes to the library once as long as the
    bounded memory lasts. That follows from the rules that the file states (``_rules_part_at_spaces``); a few probe texts
    check on top that the library keeps to them (``apart``, ``letters``). Otherwise, or where a text has a character that
    Python and the library may treat unlike, the library encodes the whole text.
    """

    MEMORY, LONGEST = 800_000, 48

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        probe = _rules_part_at_spaces(path) and ["The  quick", "brown\n\tfox's", "123 abc!?", "Ünïcode text <|endoftext|> x", "a b 　c"]
        self.apart = bool(probe) and all(self.whole(t) == b"".join(self.whole(w) for w in t.split()) for t in probe)
        stems = ["able", "unquestionably", "über", "straße", "日本語", "ciónadoes", "x", "éé"]
        self.letters = self.apart and all(self._merged(w) == self.whole(w) for w in stems)

    def whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, letters: str) -> bytes:
        """The ids of small letters alone, which the normaliser leaves and the pre-tokenizer keeps together."""
        return _little([t.id for t in self.tokenizer.model.tokenize(letters.encode().decode("latin-1").translate(_BYTE_LETTERS))])

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of these texts that aren't known yet.

        The pre-tokenizer parts letters from the full stops, commas and the like behind them, and the normaliser makes
        letters small; so such a word is its letters, lower-cased, which the merges alone encode, and its tail.
        """
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > self.MEMORY:
            self.clear()
            new = set().union(*texts)
        rest = []
        for w in new:
            stem = w.rstrip(".,;:!?") if self.letters else ""
            low = stem.lower()
            got = self.get(low)
            if got is None:
                if len(w) > self.LONGEST:
                    continue
                if not (low.isalpha() and len(low) == len(stem) and (low.isascii() or unicodedata.is_normalized("NFC", low))):
                    rest.append(w)
                    continue
                got = self[low] = self._merged(low)
            elif not stem.isalpha() or len(low) != len(stem):
                rest.append(w)
                continue
            if len(stem) < len(w):
                tail = w[len(stem) :]
                self[w] = got + (self[tail] if tail in self else self.setdefault(tail, self.whole(tail)))
            else:
                self[w] = got
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            if len(w) <= self.LONGEST:
                self[w] = _little(e.ids)

    def __missing__(self, word: str) -> bytes:
        return self.whole(word)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.apart or _ODD(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts."""
        if not self.apart:
            return [self.whole(t) for t in texts]
        parts = [t.split() for t in texts]
        self.learn(parts)
        return [b"".join(map(self.__getitem__, p)) if not _ODD(t) else self.whole(t) for t, p in zip(texts, parts)]


_words: dict[str, Words] = {}


def token_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, keep: list[str], text_col: str) -> DataFrame:
    """Per piece: keep, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa

        if tokenizer not in _words:
            _words[tokenizer] = Words(tokenizer)
        at, close = _words[tokenizer], _little([end_id])
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                texts = [t or "" for t in b.column(len(keep)).to_pylist()]
                rows, piece, start, size, ids = [], [], [], [], []
                for i, got in enumerate(at.all_ids(texts)):
                    got += close
                    for p, s in enumerate(range(0, len(got), 4 * length)):
                        part = got[s : s + 4 * length]
                        rows.append(i)
                        piece.append(p)
                        start.append(s // 4)
                        size.append(len(part) // 4)
                        ids.append(part)
                kept = [c.take(pa.array(rows, pa.int64())) for c in b.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())], [*keep, "piece", "start", "length", "ids"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_arrow(docs.select(*keep, F.col(text_col)), run, f"{kinds}piece int, start long, length long, ids binary")


# ---------------------------------------------------------------- bins


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indices: each piece, longest first, goes to the bin that it fills best."""
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    gaps: list[int] = []  # gaps for which a bin is open, sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(gaps, sizes[i])
        if at < len(gaps):
            gap = gaps[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(at)
            bins[b].append(i)
        else:
            gap, b = room, len(bins)
            bins.append([i])
        gap -= sizes[i]
        if gap:
            if not by_gap[gap]:
                insort(gaps, gap)
            by_gap[gap].append(b)
    return bins


class Search:
    """Local search over the underfull bins of a packing.

    The score is the sum of squared fills. Moving d tokens from a bin filled f to one filled g adds 2d(g - f) + 2d^2,
    so whatever makes the receiving bin fuller than the giving one was raises it. Each step takes a receiving bin and
    looks for what closes its gap best: a move of one piece, an exchange of one for one, or of two for one; of bins that
    could give the same, the emptiest does. Passes over all open bins, the fullest first, go on until one changes
    nothing. Every step raises the score, so the search ends.

    Pieces of one size are alike. For each size, and for each sum of two pieces of a bin, a heap has the open bins that
    hold it by their fills, and the bits of an integer tell which sizes and sums there are; both are kept up to date bin
    by bin, so ties cost nothing.
    """

    ONE, TWO = 0, 1

    def __init__(self, sizes: list[int], bins: list[list[int]], room: int):
        self.room, self.sizes = room, sizes
        self.full = [b for b in bins if sum(sizes[i] for i in b) == room]
        left = [b for b in bins if sum(sizes[i] for i in b) != room]
        self.bins: list[dict[int, list[int]]] = [{} for _ in left]
        for held, b in zip(self.bins, left):
            for i in b:
                held.setdefault(sizes[i], []).append(i)
        self.fill = [sum(sizes[i] for i in b) for b in left]
        self.stamp, self.keys = [0] * len(left), [(set(), set()) for _ in left]
        self.heaps: list[list[list]] = [[[] for _ in range(room + 1)] for _ in range(2)]
        self.count, self.there = [[0] * (room + 1) for _ in range(2)], [0, 0]
        for k in range(len(left)):
            self._note(k)

    def _note(self, k: int) -> None:
        """Bring the heaps up to date with bin k; a full or empty one is in none."""
        held, fill = self.bins[k], self.fill[k]
        open_ = 0 < fill < self.room
        own = sorted(held) if open_ else []
        pairs = {a + b for i, a in enumerate(own) for b in own[i + (len(held[a]) < 2) :] if a + b <= self.room}
        self.stamp[k] += 1
        for kind, now in ((self.ONE, set(own)), (self.TWO, pairs)):
            count, before = self.count[kind], self.keys[k][kind]
            for s in before - now:
                count[s] -= 1
                if not count[s]:
                    self.there[kind] &= ~(1 << s)
            for s in now - before:
                count[s] += 1
                self.there[kind] |= 1 << s
            for s in now:
                heappush(self.heaps[kind][s], (fill, k, self.stamp[k]))
        self.keys[k] = (set(own), pairs)

    def _giver(self, kind: int, size: int, k: int) -> int | None:
        """The emptiest bin but k that holds this size or sum."""
        heap, mine = self.heaps[kind][size], None
        while heap:
            _, j, stamp = heap[0]
            if stamp != self.stamp[j]:
                heappop(heap)
            elif j == k:
                mine = heappop(heap)
            else:
                break
        found = heap[0][1] if heap else None
        if mine:
            heappush(heap, mine)
        return found

    def _find(self, kind: int, least: int, most: int, rest: int, k: int) -> tuple[int, int] | None:
        """(size, bin): the largest of least to most that a bin may give; rest: what bin k holds besides."""
        there = self.there[kind] & ((2 << min(most, self.room)) - 1)
        while there.bit_length() > least:
            size = there.bit_length() - 1
            j = self._giver(kind, size, k)
            if j is not None and self.fill[j] < rest + size:
                return size, j
            there ^= 1 << size
        return None

    def _shift(self, size: int, a: int, b: int) -> None:
        i = self.bins[a][size].pop()
        if not self.bins[a][size]:
            del self.bins[a][size]
        self.bins[b].setdefault(size, []).append(i)
        self.fill[a] -= size
        self.fill[b] += size

    def _improve(self, k: int) -> bool:
        gap = self.room - self.fill[k]
        gained, best = 0, None  # tokens; (sizes in, giving bin, size out)
        found = self._find(self.ONE, 1, gap, self.fill[k], k)
        if found:
            gained, best = found[0], ([found[0]], found[1], 0)
        for out in sorted(self.bins[k]):
            for kind in (self.ONE, self.TWO):
                found = self._find(kind, out + gained + 1, out + gap, self.fill[k] - out, k) if gained < gap else None
                if found:
                    size, j = found
                    held, into = self.bins[j], [size]
                    if kind == self.TWO:
                        first = next(a for a in held if size - a in held and (2 * a != size or len(held[a]) > 1))
                        into = [first, size - first]
                    gained, best = size - out, (into, j, out)
        if best is None:
            return False
        into, j, out = best
        for size in into:
            self._shift(size, j, k)
        if out:
            self._shift(out, k, j)
        self._note(j)
        self._note(k)
        return True

    def run(self) -> list[list[int]]:
        least = -(-sum(self.fill) // self.room)
        changed = True
        while changed and sum(f > 0 for f in self.fill) > least:
            changed = False
            for k in sorted(range(len(self.fill)), key=lambda k: (-self.fill[k], k)):
                while 0 < self.fill[k] < self.room and self._improve(k):
                    changed = True
        return self.full + [[i for held in b.values() for i in held] for b, f in zip(self.bins, self.fill) if f]


def pack(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of indices into sizes (each 1 to room), none over room: best fit, then the local search."""
    bins = best_fit(sizes, room)
    least = -(-sum(sizes) // room)
    return bins if len(bins) == least else Search(sizes, bins, room).run()


def pack_sequences(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    group: int = GROUP,
) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids also ids.

    tokenizer: path of a tokenizers file, present on every executor. Null texts count as empty: a piece with the closing
    id alone. Null ids are kept as such and repeated rows are packed each. Other columns are ignored. An empty table
    gives no rows.

    The texts are tokenised once; pieces are written to the shared folder without their ids unless those are asked for.
    Then the pieces, a few numbers each, are dealt into groups of about ``group`` by a hash of document and piece, so a
    hot source or length can't gather in one task. A sequence's id is its group's number times 2^32 plus its place.
    """
    cut = token_pieces(docs, tokenizer, length, end_id, [id_col], text_col)
    crc = F.crc32("ids").alias("ids_crc32")
    # spread: repeated rows and null ids must not gather in one group either
    spread = F.xxhash64(F.col(id_col), F.col("piece"), F.monotonically_increasing_id()).alias("_spread")
    pieces = stored(cut.select(id_col, "piece", "start", "length", crc, *(["ids"] if with_ids else []), spread))
    groups = max(1, -(-pieces.count() // group))
    names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches):
        import pyarrow as pa

        def packed(tables):
            t = pa.Table.from_batches(tables)
            sizes = t.column("length").to_pylist()
            number = t.column("_group")[0].as_py()
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for k, b in enumerate(pack(sizes, length)):
                at = 0
                for i in b:
                    sequence[i], offset[i] = (number << 32) + k, at
                    at += sizes[i]
            out = t.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            return out.combine_chunks().to_batches()

        yield from one_group_at_a_time(batches, "_group", packed)

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    dealt = pieces.select(*names, F.pmod("_spread", F.lit(groups)).alias("_group"), "_spread").repartition(max(1, min(groups, 10_000)), "_group")
    return map_arrow(dealt.sortWithinPartitions("_group", "_spread"), run, schema)


def one_group_at_a_time(batches, column: str, fn):
    """Feed fn the rows of each value of an integer column, which are in sequence; yields what fn yields."""
    held: list = []
    for b in batches:
        at = b.schema.get_field_index(column)
        values = b.column(at).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                if held and held[-1].column(at)[0].as_py() != values[s]:
                    yield from fn(held)
                    held = []
                held.append(b.slice(s, e - s))
    if held:
        yield from fn(held)


def bins_needed(total: int, length: int) -> int:
    """The least number of sequences that could hold total tokens."""
    return -(-total // length)
