"""Token counts with a whole-token shortcut.

Which words of the vocabulary encode alone as one token is proved once, before any text is read: every piece of the
model that has its space mark only in front is encoded by the library itself, and those that come back as that single
piece form the table. A text is then parted where no piece can reach across (see ``Counter``); a part in the table
counts 1 and the library merges only the rest, each distinct part once as long as the bounded memory of parts lasts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MARK = "▁"
#: Parts held in memory at once by a worker, and the longest that is held, in characters.
MEMORY, LONGEST = 500_000, 64


class Counter(dict):
    """Counts tokens as the SentencePiece model does, part by part.

    The proof is made from the vocabulary when a counter is built. If no piece has a space mark behind another
    character, a merge can't cross from a character to a following space, so texts fall apart there. If also no piece
    has a line feed beside another character, they fall apart around each line feed too. A model that breaks the first
    rule, or whose normaliser alters a probe text, is used on whole texts without any shortcut.
    """

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        probe = " aＡ ½  é\t ﬁ x\n\n y  "
        self.parts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain) and sp.decode(sp.encode(probe)) == probe
        self.lines = self.parts and not any("\n" in p and len(p) > 1 for p in plain)
        alone = [p[1:] for p in plain if p[0] == MARK and len(p) > 1 and MARK not in p[1:] and "\n" not in p]
        if self.parts:
            self.update((word, 1) for word, got in zip(alone, sp.encode(alone, num_threads=1), strict=True) if len(got) == 1)
        # A single space mark that nothing follows in its part, as in front of a line feed.
        self[""] = len(sp.encode("\n", num_threads=1)) - 1
        self.proved = dict(self)

    def __missing__(self, part: str) -> int:
        """part: what follows one space, or, with a line feed in front, what follows a line."""
        n = len(self.model.encode(part, num_threads=1)) - (part[:1] == "\n")
        if len(part) <= LONGEST:
            if len(self) >= MEMORY + len(self.proved):
                self.clear()
                self.update(self.proved)
            self[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.parts:
            return len(self.model.encode(text, num_threads=1))
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or not self.lines:
            return self._runs(text)
        return sum(map(self.__getitem__, text.replace("\n", " \n").split(" ")))

    def _runs(self, text: str) -> int:
        """Texts in which spaces stand together or at an end: a run of spaces stays with what follows it."""
        total = 0
        for gap, part in re.findall("( +)([^ ]*)", f" {text}"):
            pieces = part.split("\n") if self.lines else [part]
            head = pieces[0]
            # The library puts one space in front of what it is given.
            total += self[head] if len(gap) == 1 else len(self.model.encode(gap[1:] + head, num_threads=1))
            total += sum(self["\n" + x] for x in pieces[1:])
        return total


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a model file; built once in each worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_bytes (UTF-8), n_tokens, over_limit.

    model: path of a SentencePiece model file, present on every executor. Null texts count as empty: no bytes and no
    tokens. Null ids stay null; repeated rows are counted each; other columns are ignored. There is no shuffle and a
    worker holds one Arrow batch and at most MEMORY short parts.
    """

    def run(batches):
        import pyarrow as pa

        at = counter(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [at.count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
