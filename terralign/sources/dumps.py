"""Files of bare numbers as a data source: spark.read.format("numbers").option("path", ...)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terralign.sources.files import opened

#: Bytes that a task holds at a time.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Piece:
    """Rows lo to hi of a file."""

    path: str
    lo: int
    hi: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder whose names don't begin with a dot or an underscore."""
    if "://" in path or path.startswith("file:"):
        store, inside = fs.FileSystem.from_uri(path)
        named = lambda p: f"{path.split('://')[0]}://{p}" if "://" in path else p
    else:
        store, inside, named = fs.LocalFileSystem(), path, lambda p: p
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(inside))
    return sorted((named(f.path), f.size) for f in found if f.is_file and f.base_name[:1] not in "._")


def dealt(files: list[tuple[str, int]], row: int, most: int, width: int = 1) -> list[list[Piece]]:
    """Files cut at borders of rows of so many bytes, packed to partitions of at most most bytes (one row at least). ValueError for a file that isn't whole rows."""
    rows = max(1, most // row)
    out: list[list[Piece]] = []
    room = 0
    for path, size in files:
        if size % row:
            raise ValueError(f"{path} is not made of rows of {width} numbers, {row} bytes")
        at, n = 0, size // row
        while at < n:
            if not room:
                out.append([])
                room = rows
            take = min(room, n - at)
            out[-1].append(Piece(path, at, at + take))
            at, room = at + take, room - take
    return out


class NumbersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.width = np.dtype(options.get("kind", "<f4")), int(options.get("row", "1"))
        self.row = self.kind.itemsize * self.width
        self.parts = dealt(listed(options["path"]), self.row, int(options.get("bytesPerPartition", str(32 << 20))), self.width)

    def partitions(self):
        return [Pieces(x) for x in self.parts]

    def read(self, partition: Pieces):
        step = max(1, CHUNK // self.row)
        for piece in partition.pieces:
            with opened(piece.path) as f:
                for lo in range(piece.lo, piece.hi, step):
                    n = min(step, piece.hi - lo)
                    x = np.frombuffer(f.read_at(n * self.row, lo * self.row), self.kind).astype(float)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.width, pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array([piece.path] * n, pa.string()), pa.array(np.arange(lo, lo + n)), lists], names=["file", "i", "v"])


class NumbersSource(DataSource):
    """Options: path (a file or a folder), kind (numpy's name of a type, <f4 if not given), row (numbers in one), bytesPerPartition."""

    @classmethod
    def name(cls):
        return "numbers"

    def schema(self):
        return "file string, i bigint, v array<double>"

    def reader(self, schema):
        return NumbersReader(self.options)
