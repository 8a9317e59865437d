"""The tools as functions of SQL: each row's arguments give rows, on the executors, joined LATERAL to any table.

``register`` puts them into a session under the tools' names. Arguments that are the same for all rows are checked when the
statement is analysed, so a wrong call fails before anything runs. What goes wrong with one row is told in its ``error``.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

KINDS = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType()}
# Fixed value: what a tool answers where a path is outside the directories.
DENIED = "Access denied: {} is outside allowed directories"
NUMBERS = ("tinyint", "smallint", "int", "bigint")


@dataclass
class _Edits(AnalyzeResult):
    edits: str = "[]"


def _schema(text: str) -> StructType:
    """Columns as name and type; without a session, as arguments are analysed in a process of their own."""
    out = StructType()
    for name, kind in (c.split(" ") for c in text.split(", ")):
        out = out.add(name, KINDS[kind])
    return out


def _take(given: dict[str, AnalyzeArgument], name: str, kinds: Sequence[str], constant: bool = False, needed: bool = True) -> AnalyzeArgument | None:
    a = given.get(name)
    if a is None:
        if needed:
            raise ValueError(f"{name} is missing")
        return None
    kind = a.dataType.simpleString()
    if kind != "void" and kind not in kinds:
        raise ValueError(f"{name} is {kind}, not {' or '.join(kinds)}")
    if constant and not a.isConstantExpression:
        raise ValueError(f"{name} must be the same for all rows")
    return a


def _cut(given: dict[str, AnalyzeArgument]) -> None:
    """head and tail are constants of at least 0, of which one may be above."""
    n = [(_take(given, k, NUMBERS, constant=True, needed=False), k) for k in ("head", "tail")]
    values = [a.value or 0 for a, _ in n if a is not None]
    if any(v < 0 for v in values) or sum(v > 0 for v in values) > 1:
        raise ValueError("head and tail can't be negative or both be given")


def _lines(text: str, head: int, tail: int) -> tuple[int, list[str]]:
    """The number of the first line, and the lines, of a text, its head or its tail."""
    lines = text.split("\n")
    if head:
        return 1, lines[:head]
    return (max(0, len(lines) - tail) + 1, lines[-tail:]) if tail else (1, lines)


class TextLines:
    """text_lines(text, head, tail): (line, content) of a text, its first or its last lines. Null has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, head: AnalyzeArgument | None = None, tail: AnalyzeArgument | None = None) -> AnalyzeResult:
        given = {k: v for k, v in (("text", text), ("head", head), ("tail", tail)) if v is not None}
        _take(given, "text", ["string"])
        _cut(given)
        return AnalyzeResult(_schema("line int, content string"))

    def eval(self, text: str, head: int = 0, tail: int = 0):
        if text is not None:
            first, lines = _lines(text, head or 0, tail or 0)
            for i, line in enumerate(lines, first):
                yield i, line


class EditText:
    """edit_text(text, edits): (edit, line, before, after) of every line that an edit changes; edits is JSON, a list of
    {"oldText", "newText"}, each made on what the one before has left. Null has none."""

    def __init__(self, analyzed: _Edits | None = None):
        self.edits = [(e["oldText"], e["newText"]) for e in json.loads(analyzed.edits)] if analyzed else []

    @staticmethod
    def analyze(text: AnalyzeArgument, edits: AnalyzeArgument) -> AnalyzeResult:
        given = {"text": text, "edits": edits}
        _take(given, "text", ["string"])
        asked = _take(given, "edits", ["string"], constant=True).value
        try:
            good = all(set(e) == {"oldText", "newText"} and e["oldText"] for e in json.loads(asked))
        except (TypeError, ValueError) as e:
            raise ValueError("edits is no list of edits") from e
        if not good:
            raise ValueError("each edit has oldText, which isn't empty, and newText")
        return _Edits(schema=_schema("edit int, line int, before string, after string"), edits=asked)

    def eval(self, text: str, edits: str):
        now = text.split("\n") if text is not None else []
        for k, (old, new) in enumerate(self.edits, 1):
            for i, line in enumerate(now):
                if old in line:
                    now[i] = line.replace(old, new)
                    yield k, i + 1, line, now[i]


def _inside(path: str, allowed: Sequence[str]) -> str:
    at = os.path.realpath(path)
    if not any(at == a or at.startswith(a.rstrip("/") + "/") for a in allowed):
        raise PermissionError(DENIED.format(path))
    return at


def _file_tools(allowed: Sequence[str]) -> dict[str, type]:
    """The tools over files that all executors mount, confined to some directories."""
    allowed = [os.path.realpath(a) for a in allowed]

    class ReadTextFile:
        """read_text_file(path, head, tail): (content, error) of a file, its first or its last lines."""

        @staticmethod
        def analyze(path: AnalyzeArgument, head: AnalyzeArgument | None = None, tail: AnalyzeArgument | None = None) -> AnalyzeResult:
            given = {k: v for k, v in (("path", path), ("head", head), ("tail", tail)) if v is not None}
            _take(given, "path", ["string"])
            _cut(given)
            return AnalyzeResult(_schema("content string, error string"))

        def eval(self, path: str, head: int = 0, tail: int = 0):
            try:
                with open(_inside(path or "", allowed), encoding="utf-8", newline="") as f:
                    if head and not tail:
                        text = "".join(line for line, _ in zip(f, range(head))).removesuffix("\n")
                    else:
                        text = "\n".join(_lines(f.read(), 0, tail or 0)[1])
                yield text, None
            except (OSError, ValueError) as e:
                yield None, str(e)

    class GetFileInfo:
        """get_file_info(path): (name, type, size, permissions, modified, error) of a file or directory."""

        @staticmethod
        def analyze(path: AnalyzeArgument) -> AnalyzeResult:
            _take({"path": path}, "path", ["string"])
            return AnalyzeResult(_schema("name string, type string, size bigint, permissions string, modified double, error string"))

        def eval(self, path: str):
            try:
                at = _inside(path or "", allowed)
                s = os.stat(at)
                folder = stat.S_ISDIR(s.st_mode)
                yield os.path.basename(at), "directory" if folder else "file", None if folder else s.st_size, f"{s.st_mode & 0o777:03o}", s.st_mtime, None
            except OSError as e:
                yield None, None, None, None, None, str(e)

    class ListDirectory:
        """list_directory(path): (name, type, size) by name; a directory that can't be read has no rows."""

        @staticmethod
        def analyze(path: AnalyzeArgument) -> AnalyzeResult:
            _take({"path": path}, "path", ["string"])
            return AnalyzeResult(_schema("name string, type string, size bigint"))

        def eval(self, path: str):
            try:
                with os.scandir(_inside(path or "", allowed)) as found:
                    for e in sorted(found, key=lambda e: e.name):
                        folder = e.is_dir()
                        yield e.name, "directory" if folder else "file", None if folder else e.stat().st_size
            except OSError:
                return

    return {"read_text_file": ReadTextFile, "get_file_info": GetFileInfo, "list_directory": ListDirectory}


def register(spark: SparkSession, allowed: Sequence[str] = ()) -> list[str]:
    """Make the tools functions of the session's SQL, and give their names."""
    tools = {"text_lines": TextLines, "edit_text": EditText, **_file_tools(allowed)}
    for name, tool in tools.items():
        spark.udtf.register(name, udtf(tool))
    return list(tools)
