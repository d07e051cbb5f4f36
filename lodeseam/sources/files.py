"""Files below a folder as rows, empty ones too: a data source that never enters ignored folders.

Spark's own file sources list no empty file and read ignored folders before a filter can drop them.  This one walks the tree
folder by folder, leaves ignored folders closed, and cuts the list into partitions by bytes, so that many small files and a few
large ones make tasks of like size.  Only names and lengths pass through the driver, as with Spark's sources; contents are
read in the tasks, and a task that is lost reads its own files again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X

#: Bytes of a partition, and what opening a file counts for; bytes of contents that a task hands over at once.
PARTITION_BYTES, OPEN_COST, BATCH_BYTES = 64 << 20, 64 << 10, 16 << 20

_COLUMNS = pa.schema([("path", pa.string()), ("location", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


@dataclass
class Files(InputPartition):
    """(path below the root, full path, length, whether its content is wanted) of the files of one task."""

    rows: list[tuple[str, str, int, bool]]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.contents = options.get("contents", "true") == "true"
        self.max_bytes = int(options.get("max_bytes", str(10 << 20)))
        self.partition_bytes = int(options.get("partition_bytes", str(PARTITION_BYTES)))

    def partitions(self) -> list[Files]:
        parts, size = [Files([])], 0
        for path, full, length in sorted(self._walk()):
            wanted = self.contents and (length <= self.max_bytes or supported(path))
            cost = OPEN_COST + (length if wanted else 0)
            if parts[-1].rows and size + cost > self.partition_bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].rows.append((path, full, length, wanted))
            size += cost
        return parts

    def _walk(self) -> Iterator[tuple[str, str, int]]:
        store, base = opened(self.root)
        todo = [base]
        while todo:
            try:
                found = store.get_file_info(pafs.FileSelector(todo.pop()))
            except (PermissionError, FileNotFoundError):  # unreadable, or gone since its parent was listed
                continue
            for info in found:
                if info.type == pafs.FileType.File:
                    yield info.path[len(base) :].lstrip("/"), info.path, info.size
                elif info.type == pafs.FileType.Directory and info.base_name not in X.IGNORED_SEGMENTS:
                    if not (store.type_name == "local" and os.path.islink(info.path)):  # a link may lead back up
                        todo.append(info.path)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.root)
        held, size = [], 0
        for path, full, length, wanted in partition.rows:
            content = None
            if wanted:
                try:
                    with store.open_input_stream(full) as stream:
                        content = stream.read()
                except (PermissionError, FileNotFoundError):  # not a row, as where it cannot be listed
                    continue
                length = len(content)
            held.append((path, full, length, content))
            size += len(content or b"")
            if size >= BATCH_BYTES or len(held) >= 10_000:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


class FolderSource(DataSource):
    """``spark.read.format("folder_files")``.  Options: contents (else null), max_bytes (for files of unsupported types), partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "path string, location string, length long, content binary"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _COLUMNS.types, strict=True)], schema=_COLUMNS)


def supported(path: str) -> bool:
    """Whether ``detect_language`` knows the file by its name."""
    name = path.rsplit("/", 1)[-1].lower()
    dot = name.rfind(".")
    return name in X.TEXT_NAMES or (dot > 0 and name[dot:] in X.LANGUAGES)


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The store of ``root`` and the path in it."""
    store, base = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", root))
    return store, base.rstrip("/") or "/"


def reaches(root: str) -> bool:
    """Whether tasks open ``root`` by this source: a folder that all executors mount, or an object store."""
    return root.split(":", 1)[0] in ("file", "s3", "gs") or "://" not in root


def read_folder(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """path (below root), location, length, content of all files outside ignored folders."""
    spark.dataSource.register(FolderSource)
    plain = root if "://" in root or root.startswith("file:") else os.path.abspath(root)
    reader = spark.read.format("folder_files")
    for name, value in options.items():
        reader = reader.option(name, str(value).lower())
    return reader.load(plain)
