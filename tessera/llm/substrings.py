"""Removal of repeated word windows, found through difference-cover anchors.

Word positions of a document whose remainder by PERIOD lies in COVER are anchors. COVER is a perfect difference set:
for any two positions there is a shift below PERIOD that brings both onto anchors. Two equal windows of 50 words
therefore hold a pair of anchors at the same place within the first 31 words, and the 20 words from there on, which end
inside the window, are equal. Only these 20 words are hashed and compared; a match is then extended to all windows
through the anchor. Words are compared by 96-bit digests of their own bytes (``common.digests``).
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classes import NAMES, SCHEMA, collapse, settle
from .common import among, digests, map_arrow, one_space, row_blocks, stored, text_bytes, words_of

# A perfect difference set modulo 31. Each remainder but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
_ON = np.isin(np.arange(PERIOD), COVER)


class Anchors:
    """The anchors of the documents of a batch, by numbers of words that run over all of them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int):
        self.window, self.length = window, window - PERIOD + 1
        starts, ends, self.rows = words_of(raw, offsets)
        self.data, self.begins, self.stops = one_space(raw, starts, ends)
        size = np.diff(self.rows)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(starts)) - self.rows[row]
        self.at = np.flatnonzero(_ON[place % PERIOD] & (place + self.length <= size[row]) & (size[row] >= window))
        self.row = row[self.at]
        #: From the first word of the first window through the anchor to the last word of the last one.
        self.start = np.maximum(self.at - (PERIOD - 1), self.rows[self.row])
        self.end = np.minimum(self.at + window, self.rows[self.row + 1])

    def _of(self, first: np.ndarray, n) -> tuple[np.ndarray, np.ndarray]:
        return digests(self.data, self.begins[first], self.stops[first + n - 1])

    def seeds(self) -> np.ndarray:
        return self._of(self.at, self.length)[0]

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """A digest of all the words that windows through the anchor cover; equal ones hold the same windows."""
        return self._of(self.start, self.end - self.start)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words and digests of all windows through the anchors named, each once."""
        if not len(which):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        n = self.end[which] - self.window - self.start[which] + 1
        first = np.repeat(self.start[which] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        first = np.unique(first)
        return first, *self._of(first, self.window)


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs (d long, text) to (d, marks array<struct<s, t, single>>): the digests of what of a document also starts in one
    of a smaller number: whole surroundings of anchors, and single windows. Documents without any are left out.

    Three shuffles carry numbers only; the texts of documents that have to be examined are shuffled once. Equal rows
    are combined before each shuffle, and what many documents share is settled in sorted streams, so neither copies nor
    a passage that a third of all documents hold makes more than one row a document.
    """
    if window < PERIOD + 8:
        raise ValueError(f"a window of {PERIOD + 8} words at least")

    def anchored(batches):
        import pyarrow as pa

        for b in batches:
            d = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(b.column(1))
            parts = []
            for i, j in row_blocks(offsets):
                a = Anchors(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)
                parts.append((a.seeds(), *a.around(), d[i + a.row]))
            if parts:
                out = collapse(*(np.concatenate(x) for x in zip(*parts)))
                for m in range(0, len(out[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[m : m + 200_000]) for x in out], NAMES)

    def examined(batches):
        import pyarrow as pa

        for b in batches:
            d = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(b.column(1))
            parts = []
            for i in range(b.num_rows):
                a = Anchors(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), window)
                wanted = b.column(2)[i].values
                _, s, t = a.windows(np.flatnonzero(among(*a.around(), np.asarray(wanted.field(0)), np.asarray(wanted.field(1)))))
                parts.append((s, s, t, np.full(len(s), d[i])))
            if parts:
                out = collapse(*(np.concatenate(x) for x in zip(*parts)))
                for m in range(0, len(out[0]), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[m : m + 200_000]) for x in out], NAMES)

    found = stored(settle(map_arrow(docs, anchored, SCHEMA)))
    close = found.where("examine").groupBy("d").agg(F.collect_set(F.struct("s", "t")).alias("wanted"))
    texts = docs.join(close, "d").select("d", "text", "wanted")
    single = settle(map_arrow(texts, examined, SCHEMA))
    both = found.where("not examine").withColumn("single", F.lit(False)).unionByName(single.withColumn("single", F.lit(True)))
    return both.groupBy("d").agg(F.collect_set(F.struct("s", "t", "single")).alias("marks"))


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: the id, n_words, n_removed, kept_sha256, and with with_text also kept, the words left.

    A word is a run of characters that aren't ASCII white space. A word goes if a window of ``window`` words that covers
    it also starts in a document with a smaller id; windows are judged on the input. kept_sha256 is of the words left,
    joined by one space, as UTF-8.

    The id is an integer. Rows with a null id have no place in the order: they lose nothing and take nothing away. Rows
    that share an id count as one document's. Null texts have no words. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"))
    marks = repeated_windows(base.where("d is not null").select("d", "text"), window)
    both = base.join(marks, "d", "left").select("_id", "text", "marks")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_words, n_removed, digest, texts = [], [], [], []
            for text, found in zip(b.column(1), b.column(2)):
                data = (text.as_py() or "").encode()
                words = data.split()
                kept = words
                if found.is_valid:
                    raw, (s, t, single) = np.frombuffer(data, np.uint8), (found.values.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                    a = Anchors(raw, np.array([0, len(raw)]), window)
                    whole = among(*a.around(), s[~single], t[~single])
                    first, ws, wt = a.windows(np.flatnonzero(~whole) if single.any() else np.zeros(0, np.int64))
                    first = first[among(ws, wt, s[single], t[single])]
                    gone = _covered(len(words), np.concatenate([a.start[whole], first]), np.concatenate([a.end[whole], first + window]))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            out = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return map_arrow(both, run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


#: DuckDB SQL for the rows of ``remove_repeats`` over documents; equal windows are told by their MD5.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first_id FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (k) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
