"""Files out of rows, written by the executors and seen only when all of them are there.

Each attempt of a task writes to a folder of its own below ``_attempts``. When all tasks are done the attempts that count are
noted in a journal and their files renamed to their places; when the job fails its folder is removed. A job that dies between
the note and the last rename is brought to its end by ``recover``, one that dies before leaves nothing to be seen.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .log import file_system

#: Renames at once.
THREADS = 16


@dataclass
class _Done(WriterCommitMessage):
    folder: str
    files: int
    size: int


def _key(name: str) -> str:
    """The key of a name, which must stay below the root and out of the sink's own folders."""
    at = posixpath.normpath(name)
    if not name or at != name or at.startswith(("/", "../", "_attempts/", "_journal/")) or at in ("..", "."):
        raise ValueError(f"{name!r} can't be a file's name")
    return at


def _finish(fs, root: str, job: dict) -> None:
    """Rename what a noted job has written; files that are renamed already aren't there any more. Only names are handled
    here, one attempt's at a time."""
    from pyarrow.fs import FileSelector

    def place(source: str, folder: str) -> None:
        target = f"{root}/{source[len(folder) + 1 :]}"
        fs.create_dir(posixpath.dirname(target), recursive=True)
        fs.move(source, target)

    with ThreadPoolExecutor(THREADS) as pool:
        for folder in job["folders"]:
            below = fs.get_file_info(FileSelector(folder, recursive=True, allow_not_found=True))
            list(pool.map(lambda f: place(f.path, folder), [f for f in below if f.is_file]))
    _drop(fs, f"{root}/_attempts/{job['job']}")
    fs.delete_file(f"{root}/_journal/{job['job']}.json")


def _drop(fs, folder: str) -> None:
    from pyarrow.fs import FileType

    if fs.get_file_info(folder).type != FileType.NotFound:
        fs.delete_dir(folder)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex
        self.at = [schema.names.index(options.get(k, k)) for k in ("name", "content")]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        t = TaskContext.get()
        folder = f"{root}/_attempts/{self.job}/{t.partitionId() if t else 0}-{t.taskAttemptId() if t else 0}-{uuid.uuid4().hex[:8]}"
        made, size, there = 0, 0, set()
        for batch in iterator:
            for name, content in zip(*(batch.column(i) for i in self.at)):
                target = f"{folder}/{_key(name.as_py())}"
                up = posixpath.dirname(target)
                if up not in there:
                    fs.create_dir(up, recursive=True)
                    there.add(up)
                body = content.as_py() or b""
                body = body.encode() if isinstance(body, str) else body
                with fs.open_output_stream(target) as f:
                    f.write(body)
                made, size = made + 1, size + len(body)
        return _Done(folder, made, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        job = {"job": self.job, "folders": [m.folder for m in messages if m is not None and m.files]}
        fs.create_dir(f"{root}/_journal", recursive=True)
        with fs.open_output_stream(f"{root}/_journal/.{self.job}") as f:
            f.write(json.dumps(job).encode())
        fs.move(f"{root}/_journal/.{self.job}", f"{root}/_journal/{self.job}.json")
        _finish(fs, root, job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.path)
        _drop(fs, f"{root}/_attempts/{self.job}")


class ObjectsSink(DataSource):
    """format("objects"), mode append: options path, and name and content, the columns of a file's path below it and of its
    bytes or text. A file of that name is replaced. Of rows of one name in a job any one may stay; ``write_objects`` settles
    that before."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def writer(self, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("files are only added or replaced: use mode append")
        return _Writer(self.options, schema)


def write_objects(df: DataFrame, path: str, name: str = "name", content: str = "content", order: str | None = None, distinct: bool = False) -> None:
    """Write each row's content to the file of its name below path, all or none. Null contents are empty files, rows without
    a name are an error. Of one name the last by order is written, of equal or no orders the greatest content; with distinct
    the caller vouches for there being no such rows, which saves a shuffle of the contents."""
    df.sparkSession.dataSource.register(ObjectsSink)
    rows = df.select(F.col(name).alias("name"), F.col(content).alias("content"), *([F.col(order).alias("_ord")] if order else []))
    if not distinct:
        rows = rows.groupBy("name").agg(F.max_by("content", F.struct(*(["_ord"] if order else []), "content")).alias("content"))
    rows.select("name", "content").write.format("objects").option("path", path).mode("append").save()


def recover(path: str) -> int:
    """Bring the jobs that were noted but not finished to their end, and say how many; what other jobs left goes. Only for
    when no job is writing there."""
    from pyarrow.fs import FileSelector

    fs, root = file_system(path)
    noted = [f for f in fs.get_file_info(FileSelector(f"{root}/_journal", allow_not_found=True)) if f.base_name.endswith(".json")]
    for f in noted:
        with fs.open_input_stream(f.path) as s:
            _finish(fs, root, json.loads(s.read()))
    for folder in ("_attempts", "_journal"):
        _drop(fs, f"{root}/{folder}")
    return len(noted)


def upload_files(spark: SparkSession, paths: DataFrame, root: str, bucket: str, prefix: str = "model/", path_col: str = "path") -> DataFrame:
    """Copy files to the keys prefix + base name of a bucket, and give (bucket, key, error) for each of paths.

    The executors read and write; a file that can't be read is an error of its own row, a bucket that isn't there one of
    all rows. Of files of one base name the greatest path is kept."""
    from pyarrow.fs import FileType

    fs, at = file_system(root)
    here = fs.get_file_info(f"{at}/{bucket}").type == FileType.Directory
    asked = paths.select(F.col(path_col).alias("path"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            contents, errors = [], []
            for p in b.column(0).to_pylist():
                content, error = None, None
                try:
                    source, place = file_system(p or "")
                    with source.open_input_stream(place) as f:
                        content = f.read()
                except (OSError, ValueError) as e:
                    error = str(e).split(". Detail")[0]
                contents.append(content)
                errors.append(error)
                if len(contents) == len(b) or sum(len(c or b"") for c in contents[-64:]) > 64 << 20:
                    done = len(contents)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(0, done), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "error"])
                    b, contents, errors = b.slice(done), [], []

    key = F.concat(F.lit(prefix), F.element_at(F.split("path", "/"), -1))
    if not here:
        return asked.select(F.lit(bucket).alias("bucket"), key.alias("key"), F.lit(f"no bucket {bucket}").alias("error"))
    read = asked.mapInArrow(run, "path string, content binary, error string").withColumn("key", key)
    write_objects(read.where("error is null"), f"{root}/{bucket}", name="key", order="path")
    return read.select(F.lit(bucket).alias("bucket"), "key", "error")
