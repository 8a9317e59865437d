"""The tools that agents call, as table functions with a registry.

A tool is a function of a ``Toolbox`` that gives a table; its description and arguments are its registry entry. Paths must
lie in the allowed directories. The store is a folder whose first level are buckets.
"""

from __future__ import annotations

import inspect
import json
import os
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import sql
from ..schemas import TOOLS
from ..session import scratch
from ..sources import files, objects

_TOOLS: dict[str, Callable] = {}
# What the tools answer.
WROTE, MADE, MOVED = "Successfully wrote to {}", "Successfully created directory {}", "Successfully moved {} to {}"
DENIED, DENIED_OBJECT = "Access denied: {} is outside allowed directories", "Access denied: {}/{}"
#: Rows of a table that go into one message.
PAGE = 1000


def _tool(f: Callable) -> Callable:
    _TOOLS[f.__name__] = f
    return f


class Toolbox:
    """Tools over some allowed directories, a store and the session's tables."""

    def __init__(self, spark: SparkSession, allowed: Sequence[str] = (), store: str | None = None):
        self.spark, self.allowed, self.store = spark, [os.path.realpath(a) for a in allowed], store

    def path(self, asked: str) -> str:
        """The resolved path; one outside the allowed directories is an error."""
        at = os.path.realpath(asked)
        if not any(at == a or at.startswith(a.rstrip("/") + "/") for a in self.allowed):
            raise PermissionError(DENIED.format(asked))
        return at

    def bucket(self, name: str, key: str = "") -> str:
        if not self.store:
            raise FileNotFoundError("no store")
        root = os.path.realpath(self.store)
        at = os.path.realpath(os.path.join(root, name, key))
        if not at.startswith(root + "/"):
            raise PermissionError(DENIED_OBJECT.format(name, key))
        return at

    def said(self, text: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(text).alias("message"))

    def registry(self) -> DataFrame:
        """(name, description, schema, ord) of all tools, the schema of their arguments as JSON."""
        kinds, rows = {"int": "integer", "bool": "boolean", "Sequence": "array"}, []
        for i, (name, f) in enumerate(_TOOLS.items()):
            args = list(inspect.signature(f).parameters.values())[1:]
            of = {a.name: {"type": kinds.get(str(a.annotation).split("[")[0], "string")} for a in args}
            need = [a.name for a in args if a.default is inspect.Parameter.empty]
            rows.append((name, inspect.getdoc(f), json.dumps({"properties": of, "required": need}), i))
        return self.spark.createDataFrame(rows, TOOLS)

    def call(self, name: str, args: Mapping[str, object]) -> DataFrame:
        """The table that a tool gives. An unknown tool is an error that says so."""
        if name not in _TOOLS:
            raise KeyError(f"{name} not found")
        return _TOOLS[name](self, **args)

    def page(self, rows: DataFrame) -> str:
        """A table as a JSON list, if it has PAGE rows at most. A larger one is written to the shared folder, and what comes is
        an object of its first rows and the place where all of them are."""
        some = [r[0] for r in rows.limit(PAGE + 1).select(F.to_json(F.struct("*"))).collect()]
        if len(some) <= PAGE:
            return f"[{','.join(some)}]"
        at = scratch(self.spark)
        rows.write.parquet(at)
        return f'{{"rows":[{",".join(some[:PAGE])}],"all":{json.dumps(at)}}}'

    def run(self, calls: Sequence[tuple[str, Mapping[str, object]]]) -> DataFrame:
        """(pos, name, result) of the calls of one message, in order: the tool's rows as JSON, or what went wrong as text.
        The results are for a message, so they are made one call at a time."""
        out = None
        for pos, (name, args) in enumerate(calls):
            try:
                rows = self.call(name, args)
                row = self.page(rows)
            except KeyError as e:
                row = str(e.args[0])
            except Exception as e:  # noqa: BLE001  a failing tool is an answer for the agent
                row = f"Error: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
            one = self.spark.range(1).select(F.lit(pos).alias("pos"), F.lit(name).alias("name"), F.lit(row).alias("result"))
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "pos int, name string, result string")


@_tool
def read_text_file(box: Toolbox, path: str, head: int = 0, tail: int = 0) -> DataFrame:
    """Read a text file, or its first or last lines"""
    return files.read_text_file(box.spark, box.path(path), int(head), int(tail))


@_tool
def read_media_file(box: Toolbox, path: str) -> DataFrame:
    """Read a picture or sound as Base64"""
    return files.read_media_file(box.spark, box.path(path))


@_tool
def read_multiple_files(box: Toolbox, paths: Sequence[str]) -> DataFrame:
    """Read several text files; those that can't be read say why"""
    rows = []
    for pos, p in enumerate(paths):
        try:
            with open(box.path(p), encoding="utf-8", newline="") as f:
                rows.append((pos, p, True, f.read(), None))
        except (OSError, ValueError) as e:
            rows.append((pos, p, False, None, "Not a file" if os.path.isdir(p) else str(e)))
    return box.spark.createDataFrame(rows, "pos int, path string, success boolean, content string, error string")


@_tool
def write_file(box: Toolbox, path: str, content: str) -> DataFrame:
    """Create or overwrite a file"""
    files.write_file(box.path(path), content)
    return box.said(WROTE.format(path))


@_tool
def edit_file(box: Toolbox, path: str, edits: Sequence[Mapping[str, str]], dry_run: bool = False) -> DataFrame:
    """Replace text in the lines of a file"""
    return box.said(files.edit_file(box.path(path), [(e["oldText"], e["newText"]) for e in edits], dry_run))


@_tool
def create_directory(box: Toolbox, path: str) -> DataFrame:
    """Create a directory and those above it"""
    files.create_directory(box.path(path))
    return box.said(MADE.format(path))


@_tool
def list_directory(box: Toolbox, path: str) -> DataFrame:
    """List a directory"""
    return files.list_directory(box.spark, box.path(path))


@_tool
def list_directory_with_sizes(box: Toolbox, path: str) -> DataFrame:
    """List a directory with the sizes of files"""
    return files.list_directory(box.spark, box.path(path), sizes=True)


@_tool
def directory_tree(box: Toolbox, path: str, exclude_patterns: Sequence[str] = (), max_depth: int = 2) -> DataFrame:
    """List all files and directories below a directory"""
    return files.directory_tree(box.spark, box.path(path), list(exclude_patterns), int(max_depth))


@_tool
def move_file(box: Toolbox, source: str, destination: str) -> DataFrame:
    """Move or rename a file or directory"""
    files.move_file(box.path(source), box.path(destination))
    return box.said(MOVED.format(source, destination))


@_tool
def search_files(box: Toolbox, path: str, pattern: str, exclude_patterns: Sequence[str] = ()) -> DataFrame:
    """Find files and directories by a glob; the exclusions are regular expressions"""
    return files.search_files(box.spark, box.path(path), pattern, list(exclude_patterns))


@_tool
def get_file_info(box: Toolbox, path: str) -> DataFrame:
    """Sizes, times and permissions of a file or directory"""
    return files.file_info(box.spark, box.path(path))


@_tool
def list_allowed_directories(box: Toolbox) -> DataFrame:
    """The directories that tools may use"""
    return files.allowed_directories(box.spark, box.allowed)


def _object(box: Toolbox, bucket: str, key: str) -> DataFrame:
    """One object of a bucket, by its own path; the content is unread until it is asked for."""
    at = box.bucket(bucket, key)
    if not os.path.getsize(at):  # which the scan leaves out
        o = box.spark.range(1).select(F.lit(key).alias("key"), F.lit(0).cast("long").alias("size"), F.lit(b"").alias("content"))
    else:
        o = objects.scan_folder(box.spark, at).withColumn("key", F.lit(key))
    return o.withColumn("content_type", files.mime_type(F.col("key"))).withColumn("etag", F.md5("content"))


@_tool
def list_buckets(box: Toolbox) -> DataFrame:
    """List the buckets of the store"""
    root = os.path.realpath(box.store or "")
    made = lambda n: datetime.fromtimestamp(os.stat(os.path.join(root, n)).st_ctime, timezone.utc).isoformat()
    names = sorted(n for n in os.listdir(root) if os.path.isdir(os.path.join(root, n))) if box.store else []
    return box.spark.createDataFrame([(n, made(n)) for n in names], "name string, creation_date string")


@_tool
def list_objects(box: Toolbox, bucket: str, prefix: str = "") -> DataFrame:
    """List the objects of a bucket whose keys have a prefix"""
    return objects.list_folder(box.spark, box.bucket(bucket), prefix)


@_tool
def get_object(box: Toolbox, bucket: str, key: str) -> DataFrame:
    """Read an object, as text or Base64"""
    if not os.path.isfile(box.bucket(bucket, key)):
        return box.spark.range(1).select(F.lit(f"no object {key}").alias("error"), F.lit("NoSuchKey").alias("code"))
    return objects.get_objects(_object(box, bucket, key))


@_tool
def put_object(box: Toolbox, bucket: str, key: str, content: str, content_type: str | None = None) -> DataFrame:
    """Store an object; pictures and octet streams are given as Base64"""
    import base64

    is_binary = (content_type or "").startswith("image/") or content_type == files.OCTET_STREAM
    body = base64.b64decode(content) if is_binary else content.encode()
    at, code = box.bucket(bucket, key), "OBJECT_TOO_LARGE" if len(body) > objects.CAP else None
    if code is None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(body)
    return box.spark.range(1).select(F.lit("error" if code else "ok").alias("status"), F.lit(bucket).alias("bucket"), F.lit(key).alias("key"), F.lit(code).cast("string").alias("code"))


@_tool
def delete_object(box: Toolbox, bucket: str, key: str) -> DataFrame:
    """Delete an object; one that isn't there is no error"""
    at = box.bucket(bucket, key)
    if os.path.isfile(at):
        os.remove(at)
    return box.spark.range(1).select(F.lit("ok").alias("status"), F.lit(bucket).alias("bucket"), F.lit(key).alias("key"))


@_tool
def execute_query(box: Toolbox, query: str) -> DataFrame:
    """Run one SQL statement"""
    return sql.execute_query(box.spark, query)


@_tool
def list_tables(box: Toolbox, schema: str | None = None) -> DataFrame:
    """List the tables of a schema"""
    return sql.list_tables(box.spark, schema)


@_tool
def get_table_schema(box: Toolbox, table: str) -> DataFrame:
    """The columns of a table"""
    return sql.get_table_schema(box.spark, table)
