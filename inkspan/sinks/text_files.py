"""A sink of one text file per name, whole or not at all.

Tasks write below a folder of their job, each attempt in one of its own, and hold the part at hand only. The commit moves the
files to their places and then writes _SUCCESS; an aborted job takes its folder away and leaves what was there before.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

DONE = "_SUCCESS"
#: Bytes and files that a task reads ahead.
READ_BYTES, READ_FILES = 1 << 23, 4096


def _folder(path: str) -> str:
    """The path of a folder that the driver and all executors have mounted."""
    kind, colon, rest = path.partition(":")
    if not colon or "/" in kind:
        return path
    if kind != "file":
        raise ValueError(f"files are written to mounted folders only, not to {path}")
    return "/" + rest.lstrip("/")


def file_name(name: str, suffix: str) -> str:
    """A name as that of one file: what could part folders or hide the file is escaped by percent signs."""
    if not name:
        raise ValueError("a file needs a name")
    escaped = quote(name, safe="")
    return (f"%{ord(escaped[0]):02X}{escaped[1:]}" if escaped[0] in "._" else escaped) + suffix


def _leaving(folder: str, which: Callable[[os.DirEntry], bool] = lambda e: True) -> Iterator[os.DirEntry]:
    """The entries of a folder that the caller takes out of it; it is listed again until none is left, as a listing may pass
    over entries when others go."""
    found = True
    while found:
        found = False
        with os.scandir(folder) as entries:
            for e in entries:
                if which(e):
                    found = True
                    yield e


@dataclass
class Written(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.job = os.path.join(path, f"_temporary-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        task = TaskContext.get()
        folder = os.path.join(self.job, f"{task.partitionId()}-{task.taskAttemptId()}")
        os.makedirs(folder)
        out = at = None
        try:
            for name, part in iterator:
                if out is None or name != at:
                    if out:
                        out.close()
                    # a name that comes back, or comes from two tasks, is an error
                    out, at = open(os.path.join(folder, file_name(name, self.suffix)), "x", encoding="utf-8", newline=""), name
                out.write(part or "")
        finally:
            if out:
                out.close()
        return Written(folder)

    def commit(self, messages) -> None:
        """Moves files one by one, so that no list of them is held: first together, where two of one name show, then out."""
        done = os.path.join(self.job, "done")
        os.makedirs(done, exist_ok=True)
        for message in filter(None, messages):
            for e in _leaving(message.folder):
                to = os.path.join(done, e.name)
                if os.path.lexists(to):
                    raise ValueError(f"{e.name} was written by two tasks")
                os.replace(e.path, to)
        os.makedirs(self.path, exist_ok=True)
        if os.path.exists(os.path.join(self.path, DONE)):
            os.remove(os.path.join(self.path, DONE))
        if self.overwrite:
            old = lambda e: e.name.endswith(self.suffix) and e.is_file() and not os.path.lexists(os.path.join(done, e.name))
            for e in _leaving(self.path, old):
                os.remove(e.path)
        for e in _leaving(done):
            os.replace(e.path, os.path.join(self.path, e.name))
        shutil.rmtree(self.job, ignore_errors=True)
        with open(os.path.join(self.path, DONE), "w"):
            pass

    def abort(self, messages) -> None:
        shutil.rmtree(self.job, ignore_errors=True)


class TextFiles(DataSource):
    """Format `one_text_per_file`: columns file and part (texts); options path and suffix. A file's rows must follow one
    another, as write_texts sees to."""

    @classmethod
    def name(cls) -> str:
        return "one_text_per_file"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["file", "part"]:
            raise ValueError("the columns must be file and part")
        return _Writer(_folder(self.options["path"]), self.options.get("suffix", ".txt"), overwrite)


def write_texts(parts: DataFrame, path: str, file: str = "file", order: Sequence[str] = ("page", "line", "tie"), part: str = "part", suffix: str = ".txt", mode: str = "append") -> None:
    """One file per value of `file` in path, of its parts in order, as they are; null parts are empty.

    A null or empty name fails the job, which then leaves the folder as it was; so does a name too long for a file. append replaces files of equal names and keeps the others, overwrite takes the others of that suffix
    away. Files of an existing name are replaced one by one, so readers wait for _SUCCESS. One file is written by one
    task, which sorts its rows on disk where memory ends and holds one of them.
    """
    parts.sparkSession.dataSource.register(TextFiles)
    named = parts if dict(parts.dtypes)[file] == "string" else parts.withColumn(file, F.col(file).cast("string"))
    # a window keeps rows that stand by file where they are, which renderings leave so; its number must be read to stay
    rows = named.withColumn("__n", F.row_number().over(Window.partitionBy(file).orderBy(*order))).where("__n > 0")
    rows.select(F.coalesce(F.col(file), F.lit("")).alias("file"), F.col(part).alias("part")).write.format(TextFiles.name()).option("suffix", suffix).mode(mode).save(path)


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(file, content) of the files that write_texts wrote; content is one value per file. Files without a byte have no row;
    what the renderings write has a line feed at least.

    Each task lists the folder, keeps the names whose checksum is its own, and holds some files at a time. Spark's reader of
    files would list all of them in the driver.
    """
    folder = _folder(path)
    if not os.path.exists(os.path.join(folder, DONE)):
        raise FileNotFoundError(f"no finished job in {path}")
    tasks = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (k for batch in batches for k in batch.column(0).to_pylist()):
            names, contents, held = [], [], 0
            with os.scandir(folder) as entries:
                for e in entries:
                    if not e.name.endswith(suffix) or e.name[0] in "._" or zlib.crc32(os.fsencode(e.name)) % tasks != own or not e.is_file():
                        continue
                    with open(e.path, "rb") as f:
                        content = f.read()
                    if content:
                        names.append(e.name.removesuffix(suffix))
                        contents.append(content)
                        held += len(content)
                    if held > READ_BYTES or len(names) >= READ_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])
                        names, contents, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

    files = spark.range(0, tasks, 1, tasks).mapInArrow(run, "name string, content binary")
    return files.select(F.url_decode("name").alias("file"), F.col("content").cast("string").alias("content"))
