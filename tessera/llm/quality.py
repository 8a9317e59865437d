"""A quality classifier: a convolutional network over bytes, trained and applied in numpy.

A text's UTF-8 bytes are laid out in cells of 128; a chunk is two neighbouring cells, so chunks overlap by half and
cover the whole text. Learned filters of WIDTH bytes slide over every position. Of each filter's rectified responses in a
chunk two things are kept: the greatest (max-pooling, which tells whether a pattern occurs at all; in text that repeats
itself most never do) and the average. A hidden layer weighs both for each chunk, its outputs are max-pooled over all
chunks of the text, and a logistic unit makes one probability of them. All that it knows of a text comes through the
filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_bytes, with_column

CELL, WIDTH, FILTERS, HIDDEN = 128, 4, 24, 16
#: Bytes without any response that every chunk's average counts besides its own, so that a few bytes say little.
FEW = 64
#: A byte that no UTF-8 text has: between texts.
PAD = 0xFF

#: Bounds of the training sample: labelled texts of each class, bytes of one text, chunks of one text.
PER_CLASS, LONGEST, CHUNKS = 600, 65536, 24
EPOCHS, BATCH, RATE, SEED = 14, 24, 0.01, 11
#: Small samples are gone over more often, so that as many steps are made.
STEPS = 600
#: The weight of label 1 in the loss; label 0 has the rest.
GOOD = 0.75


def _codes() -> np.ndarray:
    """What the filters see of each byte: its bits, and which sort of character it is; nothing for padding."""
    b = np.arange(256)
    bits = (b[:, None] >> np.arange(8)) & 1
    sorts = [(b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), (b == 32) | ((b >= 9) & (b <= 13)), b >= 128, (b > 32) & (b < 127) & ~np.isin(b, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8))]
    out = np.concatenate([2 * bits - 1, np.stack(sorts, 1)], axis=1).astype(np.float32)
    out[PAD] = 0
    return out


CODES = _codes()


@dataclass
class Layout:
    """Texts laid out in cells, each followed by at least one empty cell."""

    flat: np.ndarray
    first: np.ndarray  # of each text, its first cell
    cells: np.ndarray  # of each text, how many it has, one at least
    held: np.ndarray  # bytes of text in each cell


def lay_out(raw: np.ndarray, offsets: np.ndarray) -> Layout:
    size = np.diff(offsets)
    cells = np.maximum(1, -(-size // CELL))
    first = np.concatenate([[0], np.cumsum(cells + 1)[:-1]]) + 1 if len(size) else np.zeros(0, np.int64)
    total = int((cells + 1).sum()) + 2
    flat = np.full(total * CELL, PAD, np.uint8)
    held = np.zeros(total, np.int64)
    for i, (n, f) in enumerate(zip(size.tolist(), first.tolist())):
        flat[f * CELL : f * CELL + n] = raw[offsets[i] : offsets[i + 1]]
        held[f : f + n // CELL] = CELL
        if n % CELL:
            held[f + n // CELL] = n % CELL
    return Layout(flat, first, cells, held)


def chunk_cells(x: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First cell of each chunk, its second one (an empty one in texts of one cell), and the text it belongs to."""
    n = np.maximum(1, x.cells - 1)
    text = np.repeat(np.arange(len(n)), n)
    first = x.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return first, first + 1, text


@dataclass
class Net:
    """The weights. With ``weight`` None it knows no classes and gives ``prior`` to every text."""

    prior: float
    filters: np.ndarray | None = None  # (WIDTH * codes, FILTERS)
    bias: np.ndarray | None = None
    hidden: np.ndarray | None = None  # (2 * FILTERS, HIDDEN): for the averages, then for the greatest
    hidden_bias: np.ndarray | None = None
    weight: np.ndarray | None = None
    weight_bias: float = 0.0

    def tables(self) -> list[np.ndarray]:
        """The filters' responses to each pair of bytes, for the first and for the last two places."""
        c = CODES.shape[1]
        one = [CODES @ self.filters[j * c : (j + 1) * c] for j in range(WIDTH)]
        out = [(one[j][:, None] + one[j + 1][None, :]).astype(np.float32) for j in (0, 2)]
        out[0][PAD] = -1e9  # places without a byte of text have no response
        return [t.reshape(65536, FILTERS) for t in out]

    def responses(self, x: Layout, tables: list[np.ndarray], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Sums and greatest of the rectified responses over each cell's bytes of text."""
        out, top = (np.empty((len(x.held), FILTERS), np.float32) for _ in range(2))
        flat = np.concatenate([x.flat, np.full(WIDTH, PAD, np.uint8)])
        for i in range(0, len(x.held), at_once):
            j = min(len(x.held), i + at_once)
            part = flat[i * CELL : j * CELL + WIDTH].astype(np.uint16)
            pair = (part[:-1] << np.uint16(8)) | part[1:]
            n = (j - i) * CELL
            r = tables[0].take(pair[:n], axis=0)
            r += tables[1].take(pair[2 : n + 2], axis=0)
            r += self.bias
            np.maximum(r, 0, out=r)
            r = r.reshape(j - i, CELL, FILTERS)
            r.sum(axis=1, out=out[i:j])
            r.max(axis=1, out=top[i:j])
        return out, top

    def scores(self, raw: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """One probability a text."""
        if self.weight is None or len(offsets) < 2:
            return np.full(len(offsets) - 1, self.prior)
        x = lay_out(raw, offsets)
        a, b, text = chunk_cells(x)
        sums, most = self.responses(x, tables)
        inputs = np.concatenate([(sums[a] + sums[b]) / (FEW + x.held[a] + x.held[b])[:, None], np.maximum(most[a], most[b])], 1)
        # Column by column, so that a text's score doesn't depend on what it is scored with.
        h = np.tanh(sum(inputs[:, k, None] * self.hidden[k] for k in range(inputs.shape[1])) + self.hidden_bias)
        top = np.maximum.reduceat(h, np.searchsorted(text, np.arange(len(offsets) - 1)), axis=0)
        return 1 / (1 + np.exp(-np.clip(top.astype(np.float64) @ self.weight + self.weight_bias, -40, 40)))


def train(texts: Sequence[str], labels: Sequence[int], seed: int = SEED, chunks: int = CHUNKS) -> Net:
    """A network fitted to labelled texts (1 good, 0 bad) by Adam on the logistic loss, label 1 with weight GOOD in all.

    Of a text with more than ``chunks`` chunks as many, evenly spread, take part. The same samples, in the same order,
    give the same network. With no samples of one class the result gives the smoothed share of label 1 to every text.
    """
    y = np.asarray(labels, np.float64)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(y) == 0 or y.min() == y.max():
        return Net(prior)
    rng = np.random.default_rng(seed)
    c = CODES.shape[1]
    data = [t.encode() for t in texts]
    x = lay_out(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    a, b, text = chunk_cells(x)
    flat = np.concatenate([x.flat, np.full(WIDTH, PAD, np.uint8)])
    own: list[np.ndarray] = []
    for i in range(len(data)):
        at = np.flatnonzero(text == i)
        own.append(at if len(at) <= chunks else at[np.unique(np.linspace(0, len(at) - 1, chunks).astype(int))])
    p = {
        "w": rng.normal(0, 0.12, (WIDTH * c, FILTERS)), "wb": np.zeros(FILTERS),
        "h": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)), "hb": np.zeros(HIDDEN),
        "o": rng.normal(0, 0.3, HIDDEN), "ob": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    share = {1: GOOD / y.mean(), 0: (1 - GOOD) / (1 - y.mean())}
    step, epochs = 0, max(EPOCHS, -(-STEPS // -(-len(data) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            mine = [own[d] for d in docs]
            at = np.concatenate(mine)
            starts = np.cumsum([0, *map(len, mine)])
            place = (a[at, None] * CELL + np.arange(2 * CELL)).ravel()
            use = flat[place] != PAD
            cols = np.concatenate([CODES[flat[place + j]] for j in range(WIDTH)], axis=1)
            r = (np.maximum(cols @ p["w"] + p["wb"], 0) * use[:, None]).reshape(len(at), 2 * CELL, FILTERS)
            n = (FEW + use.reshape(-1, 2 * CELL).sum(1)).astype(np.float32)
            peak = r.argmax(axis=1)
            inputs = np.concatenate([r.sum(1) / n[:, None], np.take_along_axis(r, peak[:, None], 1)[:, 0]], 1)
            h = np.tanh(inputs @ p["h"] + p["hb"])
            top = np.maximum.reduceat(h, starts[:-1], axis=0)
            z = top @ p["o"] + p["ob"]
            t = y[docs]
            dz = ((1 / (1 + np.exp(-z)) - t) * np.where(t == 1, share[1], share[0]) / len(docs)).astype(np.float32)
            g = {"o": top.T @ dz, "ob": dz.sum(keepdims=True)}
            dh = np.zeros_like(h)
            for k, (i0, i1) in enumerate(zip(starts, starts[1:])):
                win = i0 + h[i0:i1].argmax(0)
                dh[win, np.arange(HIDDEN)] = dz[k] * p["o"]
            dh *= 1 - h * h
            g |= {"h": inputs.T @ dh, "hb": dh.sum(0)}
            back = dh @ p["h"].T
            dr = np.repeat((back[:, :FILTERS] / n[:, None])[:, None], 2 * CELL, axis=1)
            dr[np.arange(len(at))[:, None], peak, np.arange(FILTERS)] += back[:, FILTERS:]
            dr = (dr * (r > 0)).reshape(-1, FILTERS)
            g |= {"w": cols.T @ dr, "wb": dr.sum(0)}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - RATE * (0.3 if epoch >= epochs * 2 // 3 else 1) * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + 1e-4 * p[k])
    return Net(prior, p["w"], p["wb"], p["h"], p["hb"], p["o"].astype(np.float64), float(p["ob"][0]))


def held_out(doc_id, of: int = 5):
    """Whether crc32 of the id as text is a multiple of ``of``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[int]]:
    """Up to per_class texts of each label outside the held-out fold, in an order that depends on ids alone.

    Texts of over ``longest`` bytes and null texts or labels take no part. What reaches the driver is bounded by
    2 x per_class x longest bytes.
    """
    usable = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).alias("_y"))
    rank = F.xxhash64(F.col(id_col))
    chosen = [usable.where(F.col("_y") == y).groupBy(id_col).agg(F.max("_y").alias("_y")).orderBy(rank, id_col).limit(2 * per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 4 x per_class ids
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull() & (F.octet_length("_t") <= longest))
    found = texts.join(ids, id_col).select(rank.alias("_r"), id_col, "_t", "_y")
    rows = []
    for y in (0, 1):
        rows += found.where(F.col("_y") == y).orderBy("_r", id_col, "_t").limit(per_class).collect()
    rows.sort(key=lambda r: (r["_r"], r[id_col], r["_t"]))
    return [r["_t"] for r in rows], [int(r["_y"]) for r in rows]


def score_texts(docs: DataFrame, net: Net, keep: Sequence[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The columns keep of each row and the network's probability, 0 to 1, rounded to 6 decimals.

    Null texts count as empty; empty texts have a score too, that of a chunk without bytes. Repeated rows are scored each,
    and equal texts have equal scores; ids, null ones too, are only passed on. There is no shuffle, and memory is bounded
    by one Arrow batch and the longest text.
    """
    keep = list(keep)
    names, at = with_column(keep, text_col)
    tables: list = []

    def run(batches):
        import pyarrow as pa

        if net.weight is not None and not tables:
            tables.extend(net.tables())
        for b in batches:
            raw, offsets = text_bytes(b.column(at))
            scores = np.empty(b.num_rows)
            a = 0
            while a < b.num_rows:
                e = min(b.num_rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + 1_000_000, side="right")) - 1))
                scores[a:e] = net.scores(raw[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], tables)
                a = e
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.round(scores, 6))], [*keep, out])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_arrow(docs.select(*names), run, f"{kinds}`{out}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    The network is trained on ``training_sample`` of documents and labels, outside the held-out fold. Repeated rows are
    scored each and null ids stay null; of label rows that share an id each class counts once.
    """
    net = train(*training_sample(docs, labels))
    scored = score_texts(docs, net, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
