"""The event journal: checksummed frames in files, as a Spark data source named ``journal``.

A file is an eight-byte header and frames of length, checksum and a JSON event. Frames
vary in size, so a file is read by one task; many files are read side by side. A torn
tail ends a file cleanly, a frame that fails its checksum or is too long is an error
(option ``on_corrupt``: ``fail``, the default, or ``stop``, which keeps what came before).
"""

from __future__ import annotations

import json
import os
import struct
import sys
import zlib
from collections.abc import Iterator
from glob import glob

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format: little-endian, checksum over the length's bytes and the payload.
MAGIC, VERSION, MOST = b"SNTL", 1, 1 << 20
HEADER, FRAME = "<4sI", "<II"
HEADER_SIZE, FRAME_SIZE = struct.calcsize(HEADER), struct.calcsize(FRAME)
SCHEMA = "path string, frame long, value string, seq long"


class JournalCorruption(ValueError):
    def __init__(self, path: str, offset: int, detail: str):
        super().__init__(f"{path} at byte {offset}: {detail}")
        self.offset, self.detail = offset, detail

    def __reduce__(self):
        path = self.args[0].split(" at byte ")[0]
        return JournalCorruption, (path, self.offset, self.detail)


def frame(payload: bytes) -> bytes:
    if len(payload) > MOST:
        raise ValueError(f"an event of {len(payload)} bytes is too long")
    length = struct.pack("<I", len(payload))
    return length + struct.pack("<I", zlib.crc32(length + payload)) + payload


def read_frames(path: str, on_corrupt: str = "fail") -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each whole frame."""

    def bad(offset: int, detail: str) -> None:
        if on_corrupt == "fail":
            raise JournalCorruption(path, offset, detail)

    with open(path, "rb") as f:
        head = f.read(HEADER_SIZE)
        if not head:
            return  # created and nothing written yet
        if len(head) < HEADER_SIZE or struct.unpack(HEADER, head) != (MAGIC, VERSION):
            return bad(0, "not a journal of this version")
        offset = HEADER_SIZE
        while len(head := f.read(FRAME_SIZE)) == FRAME_SIZE:
            size, crc = struct.unpack(FRAME, head)
            if size > MOST:
                return bad(offset, f"a frame of {size} bytes")
            payload = f.read(size)
            if len(payload) < size:
                return
            if zlib.crc32(head[:4] + payload) != crc:
                return bad(offset, "checksum mismatch")
            yield offset, payload
            offset += FRAME_SIZE + size


class JournalFile:
    """A journal that is appended to; opening it cuts off a torn tail, so that no frame lands inside one."""

    def __init__(self, path: str):
        self.path = path
        if os.path.exists(path) and os.path.getsize(path) >= HEADER_SIZE:
            end = HEADER_SIZE
            for offset, payload in read_frames(path):
                end = offset + FRAME_SIZE + len(payload)
            self.file = open(path, "r+b")
            self.file.truncate(end)
            self.file.seek(end)
        else:
            self.file = open(path, "wb")
            self.file.write(struct.pack(HEADER, MAGIC, VERSION))

    def append(self, event: str | dict) -> None:
        text = event if isinstance(event, str) else json.dumps(event, separators=(",", ":"))
        self.file.write(frame(text.encode()))

    def flush(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())

    @property
    def bytes_written(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.flush()
        self.file.close()

    def __enter__(self) -> JournalFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], on_corrupt: str):
        self.paths, self.on_corrupt = paths, on_corrupt

    def partitions(self) -> list[_File]:
        return [_File(p, k) for k, p in enumerate(self.paths)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:
            return
        for number, (_, payload) in enumerate(read_frames(partition.path, self.on_corrupt)):
            yield partition.path, number, payload.decode(), partition.number << 40 | number


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class _Writer(DataSourceWriter):
    """Every task writes a file of its own under a temporary name; the commit gives the names."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, rows: Iterator) -> _Written:
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}"
        temporary = os.path.join(self.folder, f".{name}.tmp")
        with JournalFile(temporary) as journal:
            for row in rows:
                journal.append(row["value"])
        return _Written(temporary, os.path.join(self.folder, f"{name}.journal"))

    def commit(self, messages: list[_Written | None]) -> None:
        if self.overwrite:
            for path in glob(os.path.join(self.folder, "*.journal")):
                os.remove(path)
        for m in filter(None, messages):
            os.replace(m.temporary, m.final)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in filter(None, messages):
            if os.path.exists(m.temporary):
                os.remove(m.temporary)


class JournalSource(DataSource):
    """``spark.read.format("journal").load(file or folder)`` and ``df.write.format("journal").save(folder)``.

    Reading gives (path, frame, value, seq), seq being a long in the order of path and
    frame; what is written is the string column ``value``. The folder must be a mounted
    one that all executors share: files are appended to and renamed in place, so the
    address of an object store or another file system is refused.
    """

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in path:
            raise ValueError(f"a journal needs a mounted folder, not {path}")
        return path

    def reader(self, schema) -> _Reader:
        path = self._path()
        paths = sorted(glob(os.path.join(path, "**", "*.journal"), recursive=True)) if os.path.isdir(path) else [path]
        return _Reader(paths, self.options.get("on_corrupt", "fail"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session; its code travels with it, so workers need no installation."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(JournalSource)


def journal_size(spark: SparkSession, path: str):
    """Bytes of each journal file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.journal").load(path).select("path", "length")
