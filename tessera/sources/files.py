"""Directories as tables: a Python data source, and the file tools on top of it."""

from __future__ import annotations

import os
import re
import shutil
import stat
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..functions.scalars import MIME_TYPES, OCTET_STREAM, base64_plain, is_media, mime_type, permissions, within
from ..operators.text import head_lines, tail_lines
from ..schemas import FILES
from .sink import write_objects


_ARROW = {"string": pa.string, "int": pa.int32, "long": pa.int64, "double": pa.float64, "boolean": pa.bool_}


class _Tree(InputPartition):
    def __init__(self, path: str, depth: int, whole: bool):
        self.path, self.depth, self.whole = path, depth, whole


class _Entry(InputPartition):
    def __init__(self, path: str, depth: int):
        self.path, self.depth = path, depth


def _excluded(name: str, patterns: Sequence[str]) -> bool:
    return any(p in name for p in patterns)


def _entry(path: str, depth: int) -> tuple | None:
    try:
        s = os.stat(path)
    except OSError:
        return None
    folder = stat.S_ISDIR(s.st_mode)
    return path, os.path.dirname(path), os.path.basename(path), depth, "directory" if folder else "file", None if folder else s.st_size, s.st_ctime, s.st_mtime, s.st_atime, s.st_mode, os.path.islink(path)


class _Reader(DataSourceReader):
    """The driver lists level by level until there are enough directories to share out; each of the last level is a
    partition with all below it, those above are partitions of their own. Excluded names and depth prune the walk.

    Filters prune it too: a whole path opens one entry and lists nothing, a parent lists one directory, the start of a path
    is walked from the last directory that it names, a greatest depth ends the walk, and entries whose name or path can't
    match aren't looked at any further. Only filters that are met that way are taken from Spark."""

    ENOUGH, MOST_LISTED, ROWS = 64, 1024, 4096

    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.most = int(options.get("maxdepth", 1 << 30))
        self.patterns = [p for p in options.get("exclude", "").split("\n") if p]
        self.names: set[str] | None = None
        self.starts: list[str] = []
        self.whole: list[str] = []
        self.parents: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if isinstance(f, EqualTo | In) and column == "name":
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            elif isinstance(f, EqualTo) and column in ("path", "parent"):
                (self.whole if column == "path" else self.parents).append(f.value)
            elif isinstance(f, StringStartsWith) and column == "path":
                self.starts.append(f.value)
            elif isinstance(f, LessThan | LessThanOrEqual) and column == "depth":
                self.most = min(self.most, f.value - isinstance(f, LessThan))
            elif isinstance(f, EqualTo) and column == "depth":
                self.most = min(self.most, f.value)
                yield f  # what lies above is for Spark to leave out
            else:
                yield f

    def _wanted(self, path: str, name: str) -> bool:
        return (self.names is None or name in self.names) and all(path.startswith(s) for s in self.starts) and all(path == w for w in self.whole)

    def _leads(self, path: str) -> bool:
        """Whether anything wanted can lie below a directory."""
        at = path + "/"
        return all(at.startswith(s) or s.startswith(at) for s in self.starts) and all(w.startswith(at) for w in self.whole) and all((p + "/").startswith(at) for p in self.parents)

    def _depth(self, path: str) -> int | None:
        """The depth at which the walk would come upon a path; None where it never would."""
        if os.path.normpath(path) != path or not path.startswith(self.root.rstrip("/") + "/"):
            return None
        parts = path[len(self.root.rstrip("/")) + 1 :].split("/")
        above = [self.root.rstrip("/") + "/" + "/".join(parts[:i]) for i in range(1, len(parts))]
        if len(parts) - 1 > self.most or any(_excluded(p, self.patterns) for p in parts) or any(os.path.islink(p) for p in above):
            return None
        return len(parts) - 1

    def _inside(self, path: str) -> list[os.DirEntry]:
        try:
            with os.scandir(path) as found:
                return sorted((e for e in found if not _excluded(e.name, self.patterns)), key=lambda e: e.name)
        except OSError:
            return []

    def _begin(self) -> tuple[str, int] | None:
        """The directory from which all that is wanted can be reached, and the depth of what it holds."""
        at = [self.root]
        at += [s.rpartition("/")[0] for s in self.starts] + self.parents
        deepest = max(at, key=len)
        if deepest == self.root or self.root.startswith(deepest.rstrip("/") + "/"):
            return self.root, 0
        depth = self._depth(deepest)
        return None if depth is None or depth >= self.most or os.path.islink(deepest) else (deepest, depth + 1)

    def partitions(self) -> list[InputPartition]:
        nothing: list[InputPartition] = [_Entry("", 0)]
        if self.whole:
            depth = self._depth(self.whole[0])
            return nothing if depth is None else [_Entry(self.whole[0], depth)]
        begin = self._begin()
        if begin is None or self.most < 0 or (self.names is not None and not self.names):
            return nothing
        if self.parents:
            return [_Tree(*begin, False)] if begin[0] == self.parents[0] else nothing
        done, level, depth = [], [begin[0]], begin[1]
        while level and depth < self.most and len(level) < self.ENOUGH and len(done) + len(level) <= self.MOST_LISTED:
            done += [_Tree(p, depth, False) for p in level]
            level = [e.path for p in level for e in self._inside(p) if e.is_dir(follow_symlinks=False) and self._leads(e.path)]
            depth += 1
        return done + [_Tree(p, depth, depth < self.most) for p in level] or nothing

    def _rows(self, partition: InputPartition) -> Iterable[tuple]:
        if isinstance(partition, _Entry):
            path = partition.path
            row = _entry(path, partition.depth) if path and self._wanted(path, os.path.basename(path)) and os.path.dirname(path) in (self.parents or [os.path.dirname(path)]) else None
            if row is not None:
                yield row
            return
        pending = [(partition.path, partition.depth)]
        while pending:
            path, depth = pending.pop()
            for e in self._inside(path):
                row = _entry(e.path, depth) if self._wanted(e.path, e.name) and all(path == p for p in self.parents) else None
                if row is not None:
                    yield row
                if partition.whole and depth < self.most and e.is_dir(follow_symlinks=False) and self._leads(e.path):
                    pending.append((e.path, depth + 1))

    def read(self, partition: InputPartition):
        rows: list[tuple] = []
        kinds = pa.schema([(n, _ARROW[k]()) for n, k in (f.split() for f in FILES.split(", "))])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
        for row in self._rows(partition):
            rows.append(row)
            if len(rows) >= self.ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class FilesSource(DataSource):
    """format("files"): options path, maxdepth (children of path are depth 0), exclude (substrings of names, one a line,
    which leave out the entry and all below it). Links to directories are not followed; what can't be read is left out.
    The path must be on a file system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def files(spark: SparkSession, path: str, max_depth: int | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """The entries below path. Filters on path, parent, name and depth reach the walk (``_Reader``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilesSource)
    r = spark.read.format("files").option("path", path).option("exclude", "\n".join(exclude))
    return (r.option("maxdepth", str(max_depth)) if max_depth is not None else r).load()


def list_directory(spark: SparkSession, path: str, sizes: bool = False) -> DataFrame:
    """(name, type[, size]) by name; size is null for directories."""
    return files(spark, path, 0).select("name", "type", *(["size"] if sizes else [])).orderBy("name")


def directory_tree(spark: SparkSession, path: str, exclude: Sequence[str] = (), max_depth: int = 2) -> DataFrame:
    """Flat rows (path, depth, name, type) down to max_depth, the root's children being depth 0. Links count as files,
    also those to directories."""
    return files(spark, path, max_depth, exclude).select("path", "depth", "name", F.when(F.col("link"), "file").otherwise(F.col("type")).alias("type"))


def tree_from_paths(paths: DataFrame, path_col: str, max_depth: int) -> DataFrame:
    """(prefix, depth, n): the tree that /-separated paths span, without touching a file system."""
    parts = F.filter(F.split(path_col, "/"), lambda p: p != "")
    at = paths.select(parts.alias("p")).where(F.size("p") > 0)
    up_to = at.select("p", F.explode(F.sequence(F.lit(1), F.least(F.size("p"), F.lit(max_depth + 1)))).alias("k"))
    return up_to.groupBy(F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("prefix"), (F.col("k") - 1).alias("depth")).agg(F.count("*").alias("n"))


def glob_regex(pattern: str) -> str:
    """A glob of paths as a regular expression: ** any directories, * and ? within a name, [..] sets."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]*/)*", i + 3
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", j + 1
            continue
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c)
        i += 1
    return f"^(?:{out})$"


def matching(df: DataFrame, path_col: str, pattern: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose relative path matches a glob at any depth and whose base name matches none of the regular expressions."""
    out = df.where(F.col(path_col).rlike(glob_regex("**/" + pattern)))
    return out.where(~F.element_at(F.split(path_col, "/"), -1).rlike("|".join(exclude))) if exclude else out


def search_files(spark: SparkSession, path: str, pattern: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(path, type): what matches a glob at any depth below path, paths relative to it; exclude are regular expressions
    that are searched in names."""
    root = os.path.abspath(path).rstrip("/") + "/"
    rel = files(spark, path).withColumn("rel", F.substr("path", F.lit(len(root) + 1)))
    return matching(rel, "rel", pattern, exclude).select(F.col("rel").alias("path"), "type")


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, type, size, created, modified, accessed, permissions) of one file or directory; nothing else is opened."""
    at = os.path.abspath(path)
    row = files(spark, os.path.dirname(at), 0).where(F.col("path") == at)
    return row.select("path", "name", "type", "size", "created", "modified", "accessed", permissions(F.col("mode")).alias("permissions"))


def allowed_directories(spark: SparkSession, allowed: Sequence[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, allowed))).alias("path"))


def allowed_only(df: DataFrame, path_col: str, allowed: list[str]) -> DataFrame:
    return df.where(within(F.col(path_col), allowed))


def read_text_file(spark: SparkSession, path: str, head: int = 0, tail: int = 0) -> DataFrame:
    """(path, content): a whole UTF-8 file or its first or last lines; 0 means whole, both are an error."""
    if head and tail:
        raise ValueError("head and tail can't both be given")
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return t.select("path", (head_lines(F.col("value"), head) if head else tail_lines(F.col("value"), tail)).alias("content"))


def read_media_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, data): pictures and sounds of a folder, or one of them, as Base64. The names are judged by the
    reader's own filter, so nothing else is opened."""
    names = [k for k, v in MIME_TYPES.items() if v.startswith(("image/", "audio/"))]
    either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in names)
    b = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{either}}}").load(path).withColumn("mime", mime_type(F.col("path")))
    return b.where(is_media(F.col("mime"))).select("path", "mime", base64_plain(F.col("content")).alias("data"))


def read_many(requests: DataFrame, contents: DataFrame, key: str, content: str) -> DataFrame:
    """requests (pos, key) with the content found for each: success, content, error; order by pos is the caller's."""
    got = requests.join(contents.select(key, F.col(content).alias("_c"), F.lit(True).alias("_hit")), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    return got.select("pos", key, hit.alias("success"), F.col("_c").alias("content"), F.when(~hit, F.lit("not found")).alias("error"))


def inventory(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Files and bytes per group, with subtotals."""
    return df.rollup(*keys).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))


def split_scan(df: DataFrame, split: str, column: str = "split", known: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """The rows of one split; an unknown name is an error before anything runs."""
    if split not in known:
        raise ValueError(f"unknown split {split!r}")
    return df.where(F.col(column) == split)


def write_images(df: DataFrame, folder: str, sample: str = "sample", content: str = "content") -> None:
    """Write each row's picture to folder/<sample>.png, from the executors, all or none (``sink.write_objects``). Samples are
    distinct."""
    write_objects(df.select(F.concat(F.col(sample), F.lit(".png")).alias("name"), F.col(content).alias("content")), folder, distinct=True)


def write_labels(df: DataFrame, folder: str) -> None:
    df.select("sample", "label").write.mode("overwrite").csv(folder, header=True)


def write_file(path: str, content: str) -> None:
    """Overwrite one file, with the directories above it."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def create_directory(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def create_directories(df: DataFrame, path: str) -> DataFrame:
    """(path, created) for each of the paths in a column: the executors make the directories and those above them; created is
    false for one that was there or that another row made."""

    def run(batches):
        for b in batches:
            made = []
            for p in b.column(0).to_pylist():
                there = os.path.isdir(p)
                os.makedirs(p, exist_ok=True)
                made.append(not there)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.bool_())], ["path", "created"])

    return df.select(F.col(path).alias("path")).where("path is not null").mapInArrow(run, "path string, created boolean")


def move_file(source: str, destination: str) -> None:
    """Rename a file or directory, with the directories above the new place; a file that is there is replaced."""
    os.makedirs(os.path.dirname(os.path.abspath(destination)), exist_ok=True)
    os.replace(source, destination)


def edit_file(path: str, edits: Sequence[tuple[str, str]], dry_run: bool = False) -> str:
    """Make literal replacements line by line, each on what the one before left, and say what changed, line numbers from
    1. With dry_run the file stays as it is."""
    with open(path, encoding="utf-8", newline="") as f:
        now = f.read().split("\n")
    log = []
    for old, new in edits:
        after = [line.replace(old, new) for line in now]
        log += [f"Line {i}: {a} -> {b}" for i, (a, b) in enumerate(zip(now, after), 1) if old in a]
        now = after
    if not dry_run:
        write_file(path, "\n".join(now))
    return ("[DRY RUN] " if dry_run else "") + "Changes:\n" + "\n".join(log)


def create_bucket(root: str, name: str) -> None:
    """A bucket is a folder below root; one that is there already is no error."""
    os.makedirs(os.path.join(root, name), exist_ok=True)


def upload_file(root: str, bucket: str, path: str, prefix: str = "model/") -> dict:
    """Copy a file to the key prefix + base name of a bucket. What fails is said in error, not raised."""
    key = prefix + os.path.basename(path)
    try:
        if not os.path.isdir(os.path.join(root, bucket)):
            raise FileNotFoundError(f"no bucket {bucket}")
        target = os.path.join(root, bucket, key)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.copyfile(path, target)
    except OSError as e:
        return {"bucket": bucket, "key": key, "error": str(e)}
    return {"bucket": bucket, "key": key, "error": None}
