"""Byte-pair encoding and decoding by batched merge rounds in numpy.

The symbols of all distinct words of a block of texts stand in one flat array. In each round every word merges all places
of its lowest-ranked pair; pairs are looked up by binary search over sorted pair keys, and only pairs beside a merge are
looked up again. Words that have no pair left leave the array. Words of very many symbols, whose rounds would be as many,
are merged the same way but with one rank a round, the places of each rank kept in a table.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_blocks, with_column

#: Words of more symbols are merged rank by rank; characters of text that are cut into words at once; words that a worker
#: remembers between blocks, of eight characters each on average at most.
LONG, PIECE, MEMORY = 256, 1_000_000, 150_000
#: How a text falls into words before merging: a fixed value of this kind of tokenizer file ("use_regex").
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text, or ids, that are worked on at once.
BLOCK = 1_000_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file's tokens: printable Latin-1 characters stand for themselves, the
    others take the characters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@lru_cache(1)
def doubtful() -> re.Pattern:
    """Characters of which the installed libraries' Unicode versions disagree whether they are letters or numbers."""
    import regex

    patterns = {kind: regex.compile(rf"\p{{{kind}}}") for kind in "LN"}
    odd: list[int] = []
    for first in range(0, sys.maxunicode + 1, 4096):
        some = "".join(chr(c) for c in range(first, first + 4096) if not 0xD800 <= c <= 0xDFFF)
        said = {kind: set(p.findall(some)) for kind, p in patterns.items()}
        odd += [ord(c) for c in some if any((c in said[kind]) != (unicodedata.category(c)[0] == kind) for kind in "LN")]
    ranges: list[list[int]] = []
    for c in odd:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]" if ranges else "(?!)")


class Known(dict):
    """Numbers of the words met so far, and their ids; new words wait until they are merged together."""

    def __init__(self, added: dict[str, int]):
        super().__init__(zip(added, range(len(added))))
        self.new: list[str] = []
        self.size, self.ids = 0, np.array(list(added.values()), np.int32)
        self.lengths = np.ones(len(added), np.int64)
        self.starts = np.arange(len(added))

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        self.size += len(word)
        return n

    def add(self, ids: np.ndarray, off: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + off[:-1]])
        self.lengths = np.concatenate([self.lengths, np.diff(off)])
        self.ids = np.concatenate([self.ids, ids])
        self.new = []


class Coder:
    """Encodes and decodes as the library does with a byte-level tokenizer file, added special strings included.

    The file must have no normaliser, prefix space, dropout or unknown token, one letter for each byte, and merges whose
    parts are made by earlier merges; otherwise it is refused. That order is what lets all places of the lowest rank merge
    at once. Truncation, padding and the post-processor aren't used.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, pre = told["model"], told["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or told["normalizer"] or (told["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level BPE without normaliser and prefix space")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("the model has settings that aren't supported")
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        made = dict.fromkeys(letters, -1)
        for rank, (a, b) in enumerate(merges):
            if not made.get(a, rank) < rank > made.get(b, rank):
                raise ValueError("a merge comes before its parts")
            made.setdefault(a + b, rank)
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)
        added = told["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.words, self.known = regex.compile(WORDS), Known(self.added)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        # What each id stands for, in bytes.
        of_letter = {c: b for b, c in enumerate(letters)}
        kept = {i: bytes(of_letter[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        top = max(kept) + 1
        spelt = [kept.get(i, b"") for i in range(top)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.length = np.array([len(s) for s in spelt], np.int64)
        self.start = np.cumsum(self.length) - self.length

    # ------------------------------------------------------------ from texts to words

    def cut(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        out, a = [], 0
        while a < len(text):
            b = len(text)
            if b - a > PIECE:
                # Behind anything but a space, one space that a letter or mark follows always begins a word.
                found = re.compile(r"(?<=[!-~]) (?=[!-~])").search(text, a + PIECE)
                b = found.start() if found else b
            piece = text[a:b] if a or b < len(text) else text
            if not piece.isascii() and doubtful().search(piece):
                at = [span for _, span in self.library.pre_tokenize_str(piece)]
                out += [piece[x:y] for x, y in at]
            else:
                out += self.words.findall(piece)
            a = b
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the n + 1 offsets of the texts there."""
        if len(self.known) > MEMORY or self.known.size > 8 * MEMORY:
            self.known = Known(self.added)
        known = self.known
        codes, ends, number = [], [], known.__getitem__
        for text in texts:
            for part in self.special.split(text) if self.special else [text]:
                codes += [number(part)] if part in self.added else map(number, self.cut(part))
            ends.append(len(codes))
        if known.new:
            known.add(*self.merged([w.encode() for w in known.new]))
        code = np.array(codes, np.int64)
        n = known.lengths[code]
        out = known.ids[spread(known.starts[code], n)]
        return out, np.concatenate([[0], np.cumsum(n)])[np.array([0, *ends], np.int64)]

    # ------------------------------------------------------------ merging

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, found by binary search; _NONE where it is no merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE) if len(self.keys) else np.full(len(key), _NONE)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, none of them empty, in one array, and their n + 1 offsets."""
        n = np.array([len(w) for w in words], np.int64)
        if not len(n):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        sym, word = self.first[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(n)), n)
        long = n[word] > LONG
        done = [self._by_word(sym[~long], word[~long]), self._by_rank(sym[long], word[long])]
        sym, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(n)))])

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank_of(sym[inner], sym[inner + 1])
        return rank

    def _by_word(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges the lowest-ranked pair of every word, at all its places."""
        out_sym, out_word, rank = [sym[:0]], [word[:0]], self._ranks(sym, word)
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            going = np.repeat(least < _NONE, size)
            out_sym.append(sym[~going])
            out_word.append(word[~going])
            least = np.repeat(least, size)[going]
            sym, word, rank = sym[going], word[going], rank[going]
            if not len(sym):
                break
            at = every_second(np.flatnonzero(rank == least))
            sym[at] = self.result[rank[at]]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            at = place[at]
            sym, word, rank = sym[stays], word[stays], rank[stays]
            touched = np.zeros(len(sym), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            again = np.flatnonzero(touched)
            inner = again[again + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[again] = _NONE
            rank[inner] = self.rank_of(sym[inner], sym[inner + 1])
        return np.concatenate(out_sym), np.concatenate(out_word)

    def _by_rank(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges one rank, lowest first, in all words; what a round costs is the number of its places."""
        if not len(sym):
            return sym, word
        sym = sym.copy()
        behind, ahead = np.arange(-1, len(sym) - 1), np.arange(1, len(sym) + 1)
        edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        behind[edge] = -1
        ahead[np.append(edge[1:] - 1, len(sym) - 1)] = -1
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            order = order[: np.searchsorted(rank[order], _NONE)]
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rank)]):
                r = int(rank[a])
                if r not in places:
                    heapq.heappush(heap, r)
                    places[r] = []
                places[r].append(at[a:b])

        note(np.arange(len(sym)), self._ranks(sym, word))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            # A place may have merged since, or what follows it.
            at = at[(sym[at] == self.left[r]) & (ahead[at] >= 0)]
            at = at[sym[ahead[at]] == self.right[r]]
            if not len(at):
                continue
            joined = np.zeros(len(at), bool)
            joined[1:] = ahead[at[:-1]] == at[1:]
            begin = np.flatnonzero(~joined)
            at = at[(np.arange(len(at)) - begin[np.cumsum(~joined) - 1]) % 2 == 0]
            gone = ahead[at]
            sym[at], sym[gone] = self.result[r], -1
            after = ahead[gone]
            ahead[at] = after
            behind[after[after >= 0]] = at[after >= 0]
            new = np.unique(np.concatenate([at, behind[at][behind[at] >= 0]]))
            new = new[ahead[new] >= 0]
            note(new, self.rank_of(sym[new], sym[ahead[new]]))
        return sym[sym >= 0], word[sym >= 0]

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids; ids that aren't in the vocabulary stand for nothing, and bytes that are no
        UTF-8 become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.length))
        n = np.where(known, self.length[np.where(known, ids, 0)], 0)
        raw = self.spelt[spread(self.start[np.where(known, ids, 0)], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[off].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n places, of each range in turn."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    return np.repeat(starts - (ends - n), n) + np.arange(total)


def every_second(at: np.ndarray) -> np.ndarray:
    """Of places in a row (a pair that overlaps itself) the first, the third and so on."""
    if not len(at):
        return at
    new = np.append(True, np.diff(at) != 1)
    begin = np.flatnonzero(new)
    return at[(np.arange(len(at)) - begin[np.cumsum(new) - 1]) % 2 == 0]


@lru_cache(4)
def coder(path: str) -> Coder:
    """The worker's coder for a tokenizer file; built once in each worker."""
    return Coder(path)


def encode_texts(docs: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """The columns keep of docs, and the ids of each whole text: array<int>, or packed as little-endian 32-bit integers.

    tokenizer: path of a byte-level BPE file, present on every executor. Null texts count as empty and have no ids. Ids of
    special strings within texts are as the library's default gives them. Repeated rows are encoded each. A column of keep
    that is named out is refused. There is no shuffle; a worker holds one Arrow batch and the words of a megabyte of
    text, or of one longer text.
    """
    if out in keep:
        raise ValueError(f"{out} is a column of its own")
    names, at = with_column(keep, text_col)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        c = coder(tokenizer)
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in row_blocks(np.concatenate([[0], np.cumsum(size)]), BLOCK):
                part = b.slice(i, j - i)
                ids, off = c.encode([t or "" for t in part.column(at).to_pylist()])
                if packed:
                    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(off * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                else:
                    made = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), made], [*keep, out])

    kept = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep)
    return map_arrow(docs.select(*[F.col(f"`{k}`") for k in names]), run, f"{kept}`{out}` {'binary' if packed else 'array<int>'}")


def decode_ids(encoded: DataFrame, tokenizer: str, keep: list[str], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns keep of encoded, and the text that each row's ids stand for, special strings kept.

    ids_col is array<int> or packed as ``encode_texts`` packs it. No ids, or null, give an empty text; null ids in an array
    and ids that the file doesn't have stand for nothing; bytes that are no UTF-8 become U+FFFD."""
    if out in keep:
        raise ValueError(f"{out} is a column of its own")
    names, at = with_column(keep, ids_col)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        c = coder(tokenizer)
        for b in batches:
            ids = b.column(at)
            if pa.types.is_list(ids.type):
                off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
                flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
            else:
                packed = ids.cast(pa.large_binary()).to_pylist()
                off = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in packed])])
                flat = np.frombuffer(b"".join(x or b"" for x in packed), "<u4").astype(np.int64)
            for i, j in row_blocks(off, BLOCK):
                made = pa.array(c.decode(flat[off[i] : off[j]], off[i : j + 1] - off[i]), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(keep))), made], [*keep, out])

    kept = "".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}, " for k in keep)
    return map_arrow(encoded.select(*[F.col(f"`{k}`") for k in names]), run, f"{kept}`{out}` string")


def round_trip_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_tokens, ids_sha256 of its packed ids, decoded_sha256 of what they decode to, in UTF-8.

    Null and empty texts have no tokens; null ids stay null; repeated rows and any other columns are as in
    ``encode_texts``."""
    packed = encode_texts(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text")), tokenizer, ["_id"], packed=True)
    both = decode_ids(packed, tokenizer, ["_id", "ids"])
    return both.select(F.col("_id").alias(id_col), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
