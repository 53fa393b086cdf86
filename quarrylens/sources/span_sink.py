"""Spans written as JSON lines by a Python data source, for batches and streams.

A task writes a file of its own name beside the data, under ``_pending``; the
driver moves the files of the tasks that succeeded into place.  What a failed
or repeated task has left is never moved, so no span is there twice.  A batch
of a stream keeps its number in the file names: when the stream repeats a batch
after a failure, files of that number that are in place are replaced.

``path`` is a folder that all executors share, a path or any URI that Arrow's
file systems read.  An empty task writes no file.  A failed stream batch of
which no task succeeded leaves its pending files; readers see the folder only.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

PENDING = "_pending"


def _plain(value: object) -> object:
    """What JSON has no form for: times as ISO texts, exact numbers as texts."""
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    raise TypeError(f"no JSON form for {type(value).__name__}")


@dataclass
class WrittenFile(WriterCommitMessage):
    """The file that one task wrote, none for a task without spans.

    Spark commits a stream through another writer than the one its tasks have,
    so a message says which folder its file is pending in.
    """

    job: str
    name: str | None


class _Folder:
    """The folder of one write and the names in it."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def _at(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, root.rstrip("/")

    def write(self, rows: Iterator[Row]) -> WrittenFile:
        first = next(rows, None)
        if first is None:
            return WrittenFile(self.job, None)
        system, root = self._at()
        name = f"{uuid.uuid4().hex}.jsonl"
        system.create_dir(posixpath.join(root, PENDING, self.job), recursive=True)
        with system.open_output_stream(posixpath.join(root, PENDING, self.job, name)) as out:
            while first is not None:
                out.write(json.dumps(first.asDict(recursive=True), ensure_ascii=False, default=_plain).encode() + b"\n")
                first = next(rows, None)
        return WrittenFile(self.job, name)

    def names(self) -> list[str]:
        system, root = self._at()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [f.base_name for f in found if f.type == fs.FileType.File]

    def remove(self, names: list[str]) -> None:
        system, root = self._at()
        for name in names:
            system.delete_file(posixpath.join(root, name))

    def commit(self, messages: list[WrittenFile | None], prefix: str) -> None:
        system, root = self._at()
        for message in messages:
            if message is not None and message.name is not None:
                system.move(posixpath.join(root, PENDING, message.job, message.name), posixpath.join(root, f"{prefix}-{message.name}"))
        self.discard(messages)

    def discard(self, messages: list[WrittenFile | None]) -> None:
        system, root = self._at()
        for job in {self.job, *(m.job for m in messages if m is not None)}:
            pending = posixpath.join(root, PENDING, job)
            if system.get_file_info(pending).type == fs.FileType.Directory:
                system.delete_dir(pending)


class SpanBatchWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.folder, self.overwrite = _Folder(path, uuid.uuid4().hex), overwrite

    def write(self, iterator: Iterator[Row]) -> WrittenFile:
        return self.folder.write(iter(iterator))

    def commit(self, messages: list[WrittenFile | None]) -> None:
        earlier = self.folder.names() if self.overwrite else []
        self.folder.commit(messages, "part")
        self.folder.remove(earlier)

    def abort(self, messages: list[WrittenFile | None]) -> None:
        self.folder.discard(messages)


class SpanStreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.folder = _Folder(path, uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> WrittenFile:
        return self.folder.write(iter(iterator))

    def commit(self, messages: list[WrittenFile | None], batchId: int) -> None:
        prefix = f"batch-{batchId:012d}"
        self.folder.remove([n for n in self.folder.names() if n.startswith(prefix + "-")])
        self.folder.commit(messages, prefix)

    def abort(self, messages: list[WrittenFile | None], batchId: int) -> None:
        self.folder.discard(messages)


class SpanSink(DataSource):
    """``df.write.format("spans").mode("append").save(path)`` once registered with the session."""

    @classmethod
    def name(cls) -> str:
        return "spans"

    def writer(self, schema, overwrite: bool) -> SpanBatchWriter:
        return SpanBatchWriter(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> SpanStreamWriter:
        return SpanStreamWriter(self.options["path"])
