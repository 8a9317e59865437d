"""Secret scans: fixed patterns, and two character Markov models weighed against each other.

The patterns give the base spans. Other candidates are tokens of 16 or more characters with a letter among them; a token
that mixes letters and digits is a secret when a Markov model of random strings explains its characters better, by a
margin per character, than one of ordinary identifiers. Of other tokens the stretches of 16 or more characters are secrets
for which it does so by enough in sum, whatever stands beside them. Both models are trained from labelled samples.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_bytes, with_column

# Fixed patterns; letters of the keywords count in either case, ASCII only.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: The margin in nats a character from which a whole candidate, a run of the characters of ALPHABET, is a secret.
MARGIN = 0.35
#: The shortest candidate or stretch of one, and the nats in sum from which a stretch is a secret.
SHORTEST, EVIDENCE = 16, 10.0

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, len(ALPHABET), np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET), dtype=np.uint8)
_CANDIDATE = _CODE < len(ALPHABET)

# Words that ordinary identifiers are made of; the labelled samples are joined from them.
WORDS = (
    "access account action active adapter address admin after agent alert alias allow amount answer array assert asset async "
    "attribute audio author backup balance banner base batch before binary block board body boolean border bottom bound "
    "branch browser bucket buffer build bundle button byte cache call camera cancel card case catalog category center change "
    "channel chapter char chart check child choice class clean clear click client clock close cloud cluster code collect "
    "color column command comment commit compare compile component compute config connect console const contact container "
    "content context control convert cookie copy core count country create credit current cursor custom cycle daemon data "
    "database date debug decode default define delay delete deliver depth derive design detail device dialog digest direct "
    "disable discount disk display document domain double download draft driver duration dynamic edge edit element email "
    "enable encode engine entry enum environment error event example except execute expire export extend factory fail feature "
    "fetch field file filter final find first flag float flow flush folder font force format forward frame function gateway "
    "general generate global graph green group handle hash header height helper hidden history hook host icon identity image "
    "import inbox include index info init inner input insert install instance integer interface internal invoice issue item "
    "join journal json kernel keyboard label language last layer layout leader left length level library license limit line "
    "link list listen load local location lock login loop machine mail main manage mapping margin mask master match matrix "
    "media member memory menu merge message method metric middle minute mode model module monitor month mount mouse move "
    "name native network node normal notice number object offset open option order origin outer output owner package page "
    "panel parameter parent parse partition patch path pattern payment pending person phone pipeline pixel plan platform "
    "player plugin point policy pool port position post power prefix preview price primary print private process product "
    "profile progress project property protocol provider proxy public publish push query queue random range rate read ready "
    "record redirect reference refresh region register release remote remove render replace report request reset resource "
    "response result return review right role root route rule runtime sample scale schedule schema scope score screen script "
    "search second section select send sequence server service session setting shape share shell shift signal simple single "
    "size slot snapshot socket sort source space split stack stage standard start state static status step storage store "
    "stream string style subject submit suffix summary support switch symbol system table target task template tenant test "
    "text theme thread time title toggle topic total trace track traffic transform tree trigger type union unit update "
    "upload user util valid value vector version video view virtual visible volume wait warning watch weight widget width "
    "window word worker wrapper write zone"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: n that are 1, random ones (hex, base 36, base 62, base 64); n that are 0, identifiers joined from
    words in the usual styles, with counters, dates and version numbers among them; and fillers, 0 too: each character
    of the alphabet, and each of its rows, again and again. The same seed gives the same samples."""
    r = random.Random(seed)
    alphabets = ("0123456789abcdef", ALPHABET[26:62], ALPHABET[:62], ALPHABET[:64])
    out = [("".join(r.choices(r.choice(alphabets), k=r.randint(16, 48))), 1) for _ in range(n)]
    out += [(c * 200, 0) for c in ALPHABET] + [(row * 8, 0) for row in (ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62], "0123456789abcdef")]
    for _ in range(n):
        parts = r.choices(WORDS, k=r.randint(2, 5))
        if r.random() < 0.6:
            parts.insert(r.randint(1, len(parts)), r.choice((str(r.randint(0, 99)), str(r.randint(1990, 2035)), f"v{r.randint(0, 12)}", f"{r.randint(2000, 2035)}{r.randint(1, 12):02}{r.randint(1, 28):02}")))
        style = r.randrange(5)
        text = ("_".join(parts), "-".join(parts), "_".join(parts).upper(), "".join(p.title() for p in parts), "/".join(parts))[style]
        out.append((text, 0))
    return out


#: Labelled texts whose words are ordinary samples, and words of them, at most.
TEXTS, FROM_TEXTS = 400, 2000


def ordinary_words(docs: DataFrame, labels: DataFrame, texts: int = TEXTS, words: int = FROM_TEXTS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Labelled strings, all of them 0, from the corpus itself: words of five or more ASCII letters out of texts that labels
    mark as good, so that what its languages look like isn't taken for random. Up to ``texts`` of these, and an even share of
    ``words`` of each, both by a hash, the same again for the same tables; only those words reach the driver. Without good
    labels there are none. Words of more than 64 letters are no samples."""
    good = labels.where("quality = 1").select(F.col("doc_id").alias("i")).where("i is not null").distinct()
    ids = [r[0] for r in good.orderBy(F.xxhash64("i"), "i").limit(texts).collect()]
    if not ids:
        return []
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"(?<![A-Za-z])[A-Za-z]{5,64}(?![A-Za-z])"), F.lit(0))
    each = F.transform(found, lambda w, k: F.struct(F.xxhash64("i", k).alias("h"), w.alias("w")))
    some = docs.where(F.col(f"`{id_col}`").isin(ids)).withColumn("i", F.col(f"`{id_col}`")).select("i", F.slice(F.sort_array(each), 1, max(1, words // len(ids))).alias("some"))
    # Rows that share an id are one text here, whichever comes first by its words.
    rows = some.groupBy("i").agg(F.min("some.w").alias("w")).collect()
    return [(w, 0) for r in sorted(rows) for w in r.w or ()]


class Markov:
    """Log probabilities of each character after the one before, add-one smoothed."""

    def __init__(self, samples: Iterable[str]):
        n = len(ALPHABET) + 1
        counts = np.ones((n, n))
        for s in samples:
            codes = _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))


class Judge:
    """The log-likelihood ratio, in nats a character, of random string against ordinary identifier."""

    def __init__(self, samples: Sequence[tuple[str, int]]):
        self.ratio = Markov(s for s, y in samples if y).log - Markov(s for s, y in samples if not y).log

    def steps(self, codes: np.ndarray) -> np.ndarray:
        """The ratio of each character after the one before."""
        return self.ratio[codes[:-1], codes[1:]]

    def score(self, token: str) -> float:
        codes = _codes(token)
        return float(self.steps(codes).mean()) if len(codes) > 1 else 0.0


def _codes(text: str) -> np.ndarray:
    """The number of each character in ALPHABET; all others share one number."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _CODE[np.minimum(points, 255)], len(ALPHABET)).astype(np.uint8)


def stretches(text: str, lo: int, hi: int, steps: np.ndarray, margin: float) -> list[tuple[int, int]]:
    """Stretches of text[lo:hi], a token, of SHORTEST or more characters, a letter among them, whose ratios (steps, of the
    token alone) reach EVIDENCE in sum: that with the greatest sum above the margin first, then those of what is left
    beside it. Each goes on to the next of ``/=_-`` on both sides.

    The token is cut first where the sum above the margin has long been at its lowest, as no stretch goes over that, so
    the work grows with the token and not with its square.
    """
    total = np.concatenate([[0.0], np.cumsum(steps)])
    letters = np.concatenate([[0], np.cumsum(_codes(text[lo:hi]) < 52)])
    above = total - margin * np.arange(hi - lo)
    near = np.concatenate([[0], np.cumsum(above > np.minimum.accumulate(above))])
    at = np.arange(hi - lo)
    close = near[np.minimum(at + SHORTEST, hi - lo)] > near[np.maximum(at - SHORTEST, 0)]
    edges = np.flatnonzero(np.diff(close, prepend=False, append=False))
    cuts = np.array([m.start() for m in re.finditer("[/=_-]", text[lo:hi])], np.int64)
    out, left = [], list(zip(edges[::2].tolist(), edges[1::2].tolist()))
    while left:
        a0, b0 = left.pop()
        if b0 - a0 < SHORTEST:
            continue
        part = above[a0:b0]
        least = np.minimum.accumulate(part[: len(part) - SHORTEST + 1])
        e = int((part[SHORTEST - 1 :] - least).argmax())
        a, b = a0 + int(part[: e + 1].argmin()), a0 + e + SHORTEST
        if total[b - 1] - total[a] < EVIDENCE:
            continue
        i, j = np.searchsorted(cuts, a), np.searchsorted(cuts, b)
        a, b = int(cuts[i - 1]) + 1 if i else 0, int(cuts[j]) if j < len(cuts) else hi - lo
        if letters[b] > letters[a]:
            out.append((lo + a, lo + b))
        left += [(a0, a), (b, b0)]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if joined and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: matches leftmost and non-overlapping per kind, those that are too short dropped.

    A span is (start, end, kind) in code points, the whole match; sorted by start, then kind in the order of KINDS.
    """
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return ordered(found)


def ordered(spans: Iterable[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def merged(spans: Iterable[Span]) -> list[tuple[int, int]]:
    """What spans, sorted by start, cover together."""
    out: list[list[int]] = []
    for start, end, _ in spans:
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def random_spans(text: str, base: list[Span], judge: Judge, margin: float) -> list[Span]:
    """What the models add: candidates, or stretches of them, without what base spans cover. Every candidate with a letter
    is weighed; all are at once, and only those that might hold a stretch one by one."""
    codes = _codes(text)
    inside = codes < len(ALPHABET)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    steps = judge.steps(codes)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    total, most, letters, digits = sums(steps), sums(np.maximum(steps, 0)), sums(codes < 52), sums((codes >= 52) & (codes < 62))
    covered = merged(base)
    cover = np.array(covered, np.int64).reshape(-1, 2)
    first = np.searchsorted(cover[:, 1], starts, side="right")
    last = np.searchsorted(cover[:, 0], ends)
    letter, digit = letters[ends] > letters[starts], digits[ends] > digits[starts]
    mean = (total[ends - 1] - total[starts]) / (ends - 1 - starts)
    whole = letter & digit & (first >= last) & (mean >= margin)
    some = letter & ~whole & (most[ends - 1] - most[starts] >= EVIDENCE)
    out = [(a, b, "random") for a, b in zip(starts[whole].tolist(), ends[whole].tolist())]
    for k in np.flatnonzero(some).tolist():
        lo, hi = int(starts[k]), int(ends[k])
        for start, end in stretches(text, lo, hi, steps[lo : hi - 1], margin):
            i, j = np.searchsorted(cover[:, 1], start, side="right"), np.searchsorted(cover[:, 0], end)
            for a, b in [*covered[i:j], (end, end)]:
                if start < min(a, end) and re.search("[A-Za-z0-9]", text[start : min(a, end)]):
                    out.append((start, min(a, end), "random"))
                start = max(start, b)
    return sorted(out)


def may_hold(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows can hold any span: a run of 16 or more candidate characters, or an assignment sign. A necessary condition, read off the bytes of a whole batch at once."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(n, bool)
    row = lambda at: np.searchsorted(offsets, at, side="right") - 1
    flag = np.zeros(n, bool)
    cut = np.flatnonzero(np.diff(_CANDIDATE[raw], prepend=False, append=False))
    starts, ends = cut[::2], cut[1::2]
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    # A run may go on over the end of a row into the next; all rows that it touches are looked at.
    for i, j in zip(row(starts), row(ends - 1)):
        flag[i : j + 1] = True
    flag[row(np.flatnonzero((raw == 61) | (raw == 58)))] = True
    return flag


def scan_secrets(
    docs: DataFrame,
    samples: Sequence[tuple[str, int]] | None = None,
    margin: float = MARGIN,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    redact: str | None = None,
    out: str = "found",
) -> DataFrame:
    """Per row of docs: the columns keep, and out, an array of (start, end, kind) in code points, by start.

    kind is assign, access or hex for the fixed patterns, random for what the Markov models add. samples: labelled
    strings (1 random, 0 identifier) for the models; by default those of ``labelled_samples``. redact: also return the
    text with each span replaced by this string, overlapping spans by one; null texts stay null there.

    Null texts hold no span. Repeated rows are scanned each; columns that keep doesn't name are left out. There is no
    shuffle; memory is one Arrow batch.
    """
    samples = list(samples if samples is not None else labelled_samples())
    keep = [c for c in keep if redact is None or c != text_col]
    names, place = with_column(keep, text_col)
    judges: list[Judge] = []

    def spans(text: str) -> list[Span]:
        base = base_spans(text)
        return ordered([*base, *random_spans(text, base, judges[0], margin)])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        if not judges:
            judges.append(Judge(samples))
        for b in batches:
            column = b.column(place)
            flags = may_hold(*text_bytes(column))
            found: list[list[Span]] = [[] for _ in flags]
            changed = {}
            for i in np.flatnonzero(flags).tolist():
                text = column[i].as_py()
                found[i] = spans(text)
                if redact is not None and found[i]:
                    changed[i] = replaced(text, found[i], redact)
            made = [*b.columns[: len(keep)], pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found], kind)]
            if redact is not None:
                made.append(pa.array([changed.get(i, t) for i, t in enumerate(column.to_pylist())], pa.string()) if changed else column)
            yield pa.RecordBatch.from_arrays(made, [*keep, out, *([text_col] if redact is not None else [])])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}{', ' if kinds else ''}`{out}` array<struct<start: long, end: long, kind: string>>" + (f", `{text_col}` string" if redact is not None else "")
    return map_arrow(docs.select(*names), run, schema)


def replaced(text: str, spans: list[Span], by: str) -> str:
    """text with its spans, sorted by start, replaced; spans that overlap become one."""
    out, at = [], 0
    for start, end in merged(spans):
        out += [text[at:start], by]
        at = end
    return "".join([*out, text[at:]])


def secret_digest(docs: DataFrame, samples: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random; see ``scan_secrets``.

    A list of spans is written kind:start:end, comma-joined; base_sha256 is over the base spans only.
    """
    of = lambda name: F.filter("found", lambda s: s["kind"] == name)
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    n = lambda name: F.size(of(name)).cast("long").alias(f"n_{name}")
    return scan_secrets(docs, samples).select(
        "doc_id",
        n("assign"),
        n("access"),
        n("hex"),
        F.sha2(joined(F.filter("found", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        n("random"),
    )
