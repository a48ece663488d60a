"""A Python data source of messages with a big-endian 32-bit length before each, or of lines, plain or as zstd streams.

Such files can't be split, so a file is one partition; it is read on as rows are taken, and never held whole. Paths name a
file, a folder or a pattern that driver and executors all see.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

READ_BYTES = 1 << 20


def prefixed(stream) -> Iterator[bytes]:
    """Messages of a stream; raises where it ends within a length or a message."""
    while head := stream.read(4):
        if len(head) < 4:
            raise ValueError("the file ends within a length")
        (n,) = struct.unpack(">i", head)
        data = stream.read(n) if n >= 0 else b""
        if n < 0 or len(data) < n:
            raise ValueError("the file ends within a message")
        yield data


def lines(stream) -> Iterator[bytes]:
    """Lines of a stream, the last one with or without a newline."""
    for line in stream:
        yield line.rstrip(b"\n")


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.packed = options["path"].removeprefix("file:"), options.get("compression", "none") == "zstd"
        self.split = lines if options.get("framing", "length") == "line" else prefixed

    def partitions(self) -> list[InputPartition]:
        paths = glob.glob(f"{self.path}/*") if os.path.isdir(self.path) else glob.glob(self.path)
        found = sorted(p for p in paths if not os.path.basename(p).startswith((".", "_")))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        import io

        with open(partition.path, "rb", buffering=READ_BYTES) as raw:
            stream = raw
            if self.packed:
                import zstandard

                stream = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True), READ_BYTES)
            for number, data in enumerate(self.split(stream)):
                yield partition.path, number, data


class ChunkWriter(DataSourceWriter):
    """Each task writes a file under a name of its own; files of a failed job are removed. Files are cut after
    ``rows_a_file`` messages."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.packed = options["path"].removeprefix("file:"), options.get("compression", "none") == "zstd"
        self.line, self.most = options.get("framing", "length") == "line", int(options.get("rows_a_file", 0))
        if overwrite or os.path.isdir(self.path) and os.listdir(self.path):
            raise ValueError("the folder has files already")
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator) -> _Written:
        folder = f"{self.path}/.{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        out, n, files = None, 0, 0
        for row in iterator:
            if out is None or self.most and n == self.most:
                if out:
                    out.close()
                out, n, files = self._open(f"{folder}/part-{files:05d}"), 0, files + 1
            data = row["data"].encode() if isinstance(row["data"], str) else bytes(row["data"])
            out.write(data + b"\n" if self.line else struct.pack(">i", len(data)) + data)
            n += 1
        if out:
            out.close()
        return _Written(folder)

    def _open(self, path: str):
        if not self.packed:
            return open(path, "wb", buffering=READ_BYTES)
        import zstandard

        return zstandard.open(f"{path}.zst", "wb")

    def commit(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.path:
                task = os.path.basename(m.path).removeprefix(".")
                for f in sorted(os.listdir(m.path)):
                    os.rename(f"{m.path}/{f}", f"{self.path}/{f.replace('part', f'part-{task}', 1)}")
                os.rmdir(m.path)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and m.path and os.path.isdir(m.path):
                for f in os.listdir(m.path):
                    os.remove(f"{m.path}/{f}")
                os.rmdir(m.path)


class ChunkSource(DataSource):
    """Format ``chunks``: options compression (none, zstd), framing (length, line) and, for writing, rows_a_file."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return "path string, number long, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChunkWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(ChunkSource)
