"""Named files as a data source: one file per row, written and read under its path.

``spark.dataSource.register(NamedFiles)`` makes the format ``named_files`` known.  Rows are
(path, content); the path is relative to the folder, so two files of one base name in two
folders stay apart, and no folder is made for a file.

A task writes each file beside its place under a name of its own attempt and renames it when it is
whole, so a reader never meets half a file, and a task that runs twice (after the loss of an
executor, or speculatively) replaces its files by equal ones.  The job ends with the file
``_SUCCESS``, which holds the number of files; without it the job has not ended.  If the job
fails, the unfinished files are removed.

File systems are those that Arrow knows: local paths, ``hdfs://``, ``s3://`` and others.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "named_files"
SCHEMA = "path string, content binary"
DONE = "_SUCCESS"
#: Bytes and files per partition when files are read.
PART_BYTES, PART_FILES = 64_000_000, 10_000
#: Names of files that are not whole yet begin so.
HIDDEN = "._"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    found, inside = fs.FileSystem.from_uri(path)
    return found, inside.rstrip("/")


def checked(name: str) -> str:
    """A relative path that stays below its folder."""
    parts = name.split("/")
    if not name or "\0" in name or any(p in ("", ".", "..") for p in parts) or parts[-1].startswith(HIDDEN):
        raise ValueError(f"not a relative file path: {name!r}")
    if name == DONE:
        raise ValueError(f"{DONE} is the mark of a finished job")
    return name


@dataclass
class Written(WriterCommitMessage):
    files: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        system, folder = file_system(path)
        if not overwrite and system.get_file_info(f"{folder}/{DONE}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} holds the files of a finished job")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        system, folder = file_system(self.path)
        attempt = TaskContext.get().taskAttemptId()
        made: set[str] = set()
        count = 0
        for row in iterator:
            name = checked(row["path"])
            place = posixpath.join(folder, name)
            above, base = posixpath.split(place)
            if above not in made:
                system.create_dir(above, recursive=True)
                made.add(above)
            part = f"{above}/{HIDDEN}{attempt}.{base}"
            try:
                with system.open_output_stream(part) as out:
                    out.write(row["content"] or b"")
                system.move(part, place)
            except BaseException:
                if system.get_file_info(part).type != fs.FileType.NotFound:
                    system.delete_file(part)
                raise
            count += 1
        return Written(count)

    def commit(self, messages: list) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{DONE}") as out:
            out.write(str(sum(m.files for m in messages if m is not None)).encode())

    def abort(self, messages: list) -> None:
        """Nothing to do: a task removes what it has not finished, and there is no mark."""


@dataclass
class Part(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        system, folder = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        parts: list[Part] = [Part([])]
        size = 0
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or info.base_name == DONE or info.base_name.startswith(HIDDEN):
                continue
            if parts[-1].names and (size + info.size > PART_BYTES or len(parts[-1].names) >= PART_FILES):
                parts.append(Part([]))
                size = 0
            parts[-1].names.append(info.path[len(folder) + 1 :])
            size += info.size
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(self.path)
        names: list[str] = []
        contents: list[bytes] = []
        size = 0
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        for name in partition.names:
            with system.open_input_stream(posixpath.join(folder, name)) as file:
                data = file.read()
            names.append(name)
            contents.append(data)
            size += len(data)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents)], schema=schema)
                names, contents, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(contents, pa.binary())], schema=schema
            )


class NamedFiles(DataSource):
    """The format ``named_files``; the option ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write(df: DataFrame, path: str, file: str, text: str) -> None:
    """Writes ``text`` (null: empty) of each row under the relative path ``file``."""
    df.sparkSession.dataSource.register(NamedFiles)
    rows = df.select(
        F.col(file).cast("string").alias("path"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content"),
    )
    rows.write.format(FORMAT).mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of all files below ``path``."""
    spark.dataSource.register(NamedFiles)
    found = spark.read.format(FORMAT).option("path", path).load()
    return found.select(F.col("path").alias("file_name"), F.col("content").cast("string").alias("text"))
