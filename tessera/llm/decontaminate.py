"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment over words.

An alignment with m equal words and p penalties falls into p + 1 runs at most, so it holds m - p - 1 pairs of neighbouring
words of the item or more. Where its score, m - p, has to reach a share of the item's words, that many of the item's pairs
stand in the document; so of the rest some few do, whichever are left out. Left out are those that most documents of the
corpus hold: the rare ones are the seeds. A document that holds those few, and then enough of all of the item's pairs, is
aligned around them; the score of the best local alignment over the item's length tells verbatim
copies (1), edited and paraphrased ones, and chance. Nothing that scores enough is missed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, row_blocks, runs, ship, stored, text_bytes, with_column, word_hashes, words_of

#: Words in a seed, words that an item must have, the least score, and what alignments count.
GRAM, FEWEST, LEAST = 2, 3, 0.5
MATCH, MISMATCH, GAP = 1, -1, -1
#: Seeds of an item that a document must hold before it is looked at, if so many pairs of the item must be there at all.
MORE = 4
#: Bytes of item text that are sent to every executor at once; more items are worked through in blocks of this size.
ITEM_BYTES = 16_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAPS = np.ones(256, bool)
_GAPS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = False
_GAPS[128:] = False


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (ASCII letters, lower-cased, digits and all other characters beyond ASCII), and the rows."""
    raw = _LOWER[raw]
    starts, ends, rows = words_of(raw, offsets, _GAPS)
    return word_hashes(raw, starts, ends), rows


def _grams(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all n-grams, none across rows."""
    whole = np.arange(max(0, len(words) - n + 1))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[: len(whole)]
    at = whole[whole + n <= rows[row + 1]]
    return at, runs(words, at, n)


class Lookup:
    """Which of many hashes are among a few: a bitmap of their low bits first, then exactly."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.mask = np.uint64((1 << max(16, int(len(known)).bit_length() + 4)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[known & self.mask] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that are known, and their places in the sorted known ones."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[hashes & self.mask])
        place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        ok = self.known[place] == hashes[at]
        return at[ok], place[ok]


@dataclass
class Items:
    """The test items of a block, as word hashes; at and hashes are of their pairs of words."""

    ids: list
    words: np.ndarray
    rows: np.ndarray
    at: np.ndarray = field(init=False)
    hashes: np.ndarray = field(init=False)
    item: np.ndarray = field(init=False)

    def __post_init__(self):
        self.at, self.hashes = _grams(self.words, self.rows, GRAM)
        self.item = np.searchsorted(self.rows, self.at, side="right") - 1

    @classmethod
    def of(cls, ids: list, texts: Sequence[str | None]) -> Items:
        data = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b"".join(data), np.uint8)
        return cls(ids, *_words(raw, np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)))

    def enough(self, least: float) -> np.ndarray:
        """How many pairs of each item a document must hold for a score of ``least``; more than there are for short ones."""
        size = np.diff(self.rows)
        return np.where(size >= FEWEST, np.maximum(1, np.ceil(np.round(least * size, 9)).astype(np.int64) - 1), 1 << 40)

    def seeds(self, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are seeds, and how many different ones of each item a document must hold; counts: in how many
        documents each stands. Of each item the rarest, as many as could be without a match where others are left out, and MORE
        besides, so that MORE of them must be there."""
        order = np.lexsort((self.at, counts, self.item))
        place = np.arange(len(order)) - np.searchsorted(self.item[order], np.arange(len(self.rows)))[self.item[order]]
        pairs, enough = np.bincount(self.item, minlength=len(self.rows) - 1), self.enough(least)
        must = np.clip(enough, 1, MORE)
        return np.sort(order[place < (pairs - enough + must)[self.item[order]]]), must


def align(items: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """The best local alignment's score of each pair of word sequences (Smith-Waterman, linear gaps)."""
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(places[i])))
    for k in range(0, len(order), 128):
        part = order[k : k + 128]
        m, n = max(len(items[i]) for i in part), max(len(places[i]) for i in part)
        # Words that pad one side equal nothing: they are told apart by a mask.
        a, b = np.zeros((len(part), m), np.uint64), np.zeros((len(part), n), np.uint64)
        a_in, b_in = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
        for r, i in enumerate(part):
            a[r, : len(items[i])], a_in[r, : len(items[i])] = items[i], True
            b[r, : len(places[i])], b_in[r, : len(places[i])] = places[i], True
        down = -GAP * np.arange(n, dtype=np.int32)
        h = np.zeros((len(part), n + 1), np.int32)
        best = np.zeros(len(part), np.int32)
        for j in range(m):
            same = (b == a[:, j, None]) & b_in & a_in[:, j, None]
            step = np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH), h[:, 1:] + GAP)
            np.maximum(step, 0, out=step)
            # A gap along the row: the greatest of what stands to the left, less the way.
            h[:, 1:] = np.maximum.accumulate(step + down, axis=1) - down
            np.maximum(best, h.max(axis=1), out=best)
        out[part] = best
    return out


def places_to_align(hit: np.ndarray, offset: np.ndarray, doc: np.ndarray, item: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, item, first word, word after the last) of the regions around seeds. hit: word at which a seed was found;
    offset: its place in the item; size: words of each hit's item.

    Seeds of an item in a document that point to about the same start share a region, which leaves room for as many gaps
    as a score of a half allows. A region of many starts, as in
    text that repeats itself, is cut into pieces of four times the item's length that overlap by half, so that any
    alignment of up to twice the item's length lies within one.
    """
    start = hit - offset
    slack = np.maximum(8, size // 2)
    order = np.lexsort((start, item, doc))
    start, doc, item, size, slack = (x[order] for x in (start, doc, item, size, slack))
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    d, i, n = doc[first], item[first], size[first]
    lo = np.maximum(rows[d], start[first] - slack[first])
    hi = np.minimum(rows[d + 1], start[last] + n + slack[first])
    pieces = np.maximum(1, -(-(hi - lo - 4 * n) // (2 * n)) + 1)
    which = np.repeat(np.arange(len(d)), pieces)
    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo2 = lo[which] + step * 2 * n[which]
    return d[which], i[which], lo2, np.minimum(hi[which], lo2 + 4 * n[which])


class Finder:
    """Finds a block's items in texts."""

    def __init__(self, items: Items, counts: np.ndarray, least: float):
        self.items, self.least, self.enough = items, least, items.enough(least)
        chosen, self.must = items.seeds(counts, least)
        order = chosen[np.argsort(items.hashes[chosen], kind="stable")]
        known, self.from_ = np.unique(items.hashes[order], return_index=True)
        self.until, self.by_item = np.append(self.from_[1:], len(order)), items.item[order]
        self.lookup = Lookup(known)
        self.first = np.searchsorted(items.item, np.arange(len(items.rows)))

    def candidates(self, hashes: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) where as many different seeds of the item stand as must; doc: of each pair of words, the document.
        Seeds are counted for all at once, so a document and an item that share a common pair or two go no further."""
        where, which = self.lookup.find(hashes)
        n = self.until[which] - self.from_[which]
        seed = np.repeat(self.from_[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        s, m = max(1, len(self.by_item)), max(1, len(self.items.ids))
        once = np.unique(np.repeat(doc[where], n) * s + seed)
        both, held = np.unique(once // s * m + self.by_item[once % s], return_counts=True)
        both = both[held >= self.must[both % m]]
        return list(zip((both // m).tolist(), (both % m).tolist()))

    def hits(self, hashes: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Places in a document's pairs and offsets in the item of all pairs that they share; None if too few differ."""
        own = self.items.hashes[self.first[item] : self.first[item + 1]]
        order = np.argsort(own, kind="stable")
        lo, hi = np.searchsorted(own[order], hashes), np.searchsorted(own[order], hashes, side="right")
        at = np.flatnonzero(hi > lo)
        n = hi[at] - lo[at]
        offset = order[np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return (np.repeat(at, n), offset) if len(np.unique(offset)) >= self.enough[item] else None

    def found(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
        """(row, item, score) of some texts, each row and item once, with the greatest score."""
        text, rows = _words(raw, offsets)
        at, hashes = _grams(text, rows, GRAM)
        doc = np.searchsorted(rows, at, side="right") - 1
        start = np.searchsorted(doc, np.arange(len(rows)))
        parts = []
        for d, i in self.candidates(hashes, doc):
            got = self.hits(hashes[start[d] : start[d + 1]], i)
            if got is not None:
                hit, offset = at[start[d] + got[0]], got[1]
                parts.append((hit, offset, np.full(len(hit), d), np.full(len(hit), i)))
        if not parts:
            return []
        hit, offset, doc, item = (np.concatenate(x) for x in zip(*parts))
        words, item_rows = self.items.words, self.items.rows
        size = np.diff(item_rows)
        d, i, s, e = places_to_align(hit, offset, doc, item, size[item], rows)
        best: dict[tuple[int, int], float] = {}
        for k in range(0, len(d), 20_000):
            part = slice(k, k + 20_000)
            got = align([words[item_rows[x] : item_rows[x + 1]] for x in i[part]], [text[x:y] for x, y in zip(s[part], e[part])]) / size[i[part]]
            for x in np.flatnonzero(got >= self.least):
                key = (int(d[part][x]), int(i[part][x]))
                best[key] = max(best.get(key, 0), float(got[x]))
        return [(x, y, round(score, 6)) for (x, y), score in sorted(best.items())]


def _matches(docs: DataFrame, finder, keep: list[str], text_col: str, item_kind, out: str) -> DataFrame:
    """The columns keep of each row and out, an array of (item, score); finder is a broadcast ``Finder``."""
    names, place = with_column(keep, text_col)
    arrow = to_arrow_type(item_kind)

    def run(batches):
        import pyarrow as pa

        f = finder.value
        kind = pa.list_(pa.struct([("item", arrow), ("score", pa.float64())]))
        for b in batches:
            raw, offsets = text_bytes(b.column(place))
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for lo, hi in row_blocks(offsets):
                for row, item, score in f.found(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    found[lo + row].append({"item": f.items.ids[item], "score": score})
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, kind)], [*keep, out])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_arrow(docs.select(*names), run, f"{kinds}`{out}` array<struct<item: {item_kind.simpleString()}, score: double>>")


def _counts(docs: DataFrame, items: Items, text_col: str) -> np.ndarray:
    """In how many documents each pair of the items stands; as many numbers as the block has pairs."""
    known, back = np.unique(items.hashes, return_inverse=True)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        import pyarrow as pa

        lookup = Lookup(sent.value)
        total = np.zeros(len(lookup.known), np.int64)
        for b in batches:
            raw, offsets = text_bytes(b.column(0))
            for lo, hi in row_blocks(offsets):
                text, rows = _words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                at, hashes = _grams(text, rows, GRAM)
                where, which = lookup.find(hashes)
                doc = np.searchsorted(rows, at[where], side="right") - 1
                pairs = np.unique(doc * len(total) + which) % max(1, len(total))
                total += np.bincount(pairs, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    out = np.zeros(len(known), np.int64)
    for r in map_arrow(docs.select(F.col(text_col)), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    sent.unpersist()
    return out[back]


def _blocks(items: DataFrame, item_col: str, item_text: str) -> list[DataFrame]:
    """The items in parts that hold about ITEM_BYTES of text each; one part in most cases."""
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n = max(1, -(-size // ITEM_BYTES))
    part = F.pmod(F.xxhash64(item_col, item_text), F.lit(n))
    return [items.select(item_col, item_text).where(part == k) for k in range(n)] if n > 1 else [items.select(item_col, item_text)]


def find_contaminated(
    docs: DataFrame,
    items: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    least: float = LEAST,
    out: str = "found",
) -> DataFrame:
    """Per row of docs: the columns keep, and out, an array of (item, score), item being the id of a test item.

    score is the best local alignment's score over the item's words (1 for each equal word, less 1 for each that differs
    or is missing), ``least`` or more. Items of fewer than FEWEST words, and null or empty texts, match nothing. Items
    that share an id are aligned each. Repeated rows are matched each. Empty tables of either kind give no matches.

    The corpus is read twice and never shuffled: once to count pairs of words, once to seed and align. Items go to the
    executors in blocks of bounded size. With more than one block, the corpus is read twice for each; a block's matches
    are written and the block is forgotten before the next one, and rows get theirs by their numbers in the end.
    """
    keep, kind = list(keep), items.schema[item_col].dataType
    sc = docs.sparkSession.sparkContext

    def finder(block: DataFrame):
        rows = sorted(block.collect(), key=lambda r: (r[0] is None, r[0], r[1] or ""))
        known = Items.of([r[0] for r in rows], [r[1] for r in rows])
        ship(docs.sparkSession)
        return sc.broadcast(Finder(known, _counts(docs, known, text_col), least))

    parts = _blocks(items, item_col, item_text)
    if len(parts) == 1:
        return _matches(docs, finder(parts[0]), keep, text_col, kind, out)
    number = "_tessera_row"
    names, _ = with_column(keep, text_col)
    base = stored(docs.select(*names).withColumn(number, F.monotonically_increasing_id()))
    found = None
    for block in parts:
        f = finder(block)
        one = _matches(base, f, [number], text_col, kind, "_f").where(F.size("_f") > 0)
        one = stored(one.select(number, F.explode("_f").alias("_f")))
        f.unpersist()
        found = one if found is None else found.unionByName(one)
    lists = found.groupBy(number).agg(F.array_sort(F.collect_list("_f")).alias(out))
    nothing = F.array().cast(lists.schema[out].dataType)
    return base.select(number, *keep).join(lists, number, "left").select(*keep, F.coalesce(F.col(out), nothing).alias(out))


def contaminated_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score): each document and item that ``find_contaminated`` links, with the greatest score.

    Rows that share an id, also a null one, count as one document or item.
    """
    found = find_contaminated(docs, items).select("doc_id", F.explode("found").alias("f"))
    return found.groupBy("doc_id", F.col("f.item").alias("item_id")).agg(F.max("f.score").alias("score"))
