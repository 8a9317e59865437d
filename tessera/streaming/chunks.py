"""Chunks of a stream of words, released as soon as they are full."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import use_state_store

CHUNKS = "key string, chunk int, n_words int, body string"


class Chunker(StatefulProcessor):
    """Chunks of ``size`` words, each but the first with ``context`` words of the one before, of each key's parts in order.

    What is held of a key: the words of the context and of the chunk that isn't full yet, and parts that came ahead of
    their turn. A part that says it is the last ends the key; the rest of its words comes out and nothing of it is held any more."""

    def __init__(self, size: int, context: int):
        self.size, self.context = size, context

    def init(self, handle: StatefulProcessorHandle) -> None:
        # words: context and pending words, joined by spaces; held: how many of them are context.
        self.now = handle.getValueState("now", "part bigint, chunk int, held int, pending int, words string")
        self.early = handle.getMapState("early", "part bigint", "body string, last boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        part, chunk, held, pending, joined = self.now.get() if self.now.exists() else (0, 0, 0, 0, "")
        words = joined.split(" ") if held + pending else []
        for r in rows:
            if r.part >= part:
                self.early.updateValue((r.part,), (r.body or "", bool(r.last)))
        ended = False
        while not ended and self.early.containsKey((part,)):
            body, ended = self.early.getValue((part,))
            self.early.removeKey((part,))
            words += body.split(" ")
            part += 1
            while len(words) - held >= self.size:
                yield self._row(key, chunk, words[: held + self.size])
                at = held + self.size
                words, held, chunk = words[max(0, at - self.context) :], min(self.context, at), chunk + 1
        if ended:
            if len(words) > held:
                yield self._row(key, chunk, words)
            self.now.clear()
            self.early.clear()
        else:
            self.now.update((part, chunk, held, len(words) - held, " ".join(words)))

    @staticmethod
    def _row(key: Any, chunk: int, words: list[str]) -> Row:
        return Row(key=key[0], chunk=chunk, n_words=len(words), body=" ".join(words))


def stream_chunks(parts: DataFrame, size: int = 200, context: int = 50) -> DataFrame:
    """CHUNKS rows of a stream (key, part, body, last): part counts from 0 within a key, last is true for its last part.

    The chunks are those of the words of all parts one after the other (``operators.text.word_chunks``), whatever batches
    the parts come in and in what order. Words stand between single spaces; null bodies are empty. A part that comes again
    changes nothing while its key lasts."""
    use_state_store(parts.sparkSession)
    return parts.groupBy(F.col("key").cast("string").alias("key")).transformWithState(Chunker(size, context), outputStructType=CHUNKS, outputMode="append", timeMode="None")
