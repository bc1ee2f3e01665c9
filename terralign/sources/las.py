"""Uncompressed LAS point clouds as a data source: spark.read.format("las").option("path", ...)."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terralign.sources.files import opened, ranges

SCHEMA = "scene string, point_id bigint, x double, y double, z double"


@dataclass(frozen=True)
class Header:
    start: int
    record: int
    points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def parse_header(raw: bytes, size: int) -> Header:
    """LAS 1.0 to 1.4: where the points lie and how they are scaled. ValueError for other files, compressed ones and short ones."""
    if len(raw) < 227 or raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = raw[25]
    start, form, record, points = struct.unpack_from("<I4xBHI", raw, 96)
    if form & 0xC0:
        raise ValueError("compressed points")
    if minor >= 4 and len(raw) >= 255:
        points = struct.unpack_from("<Q", raw, 247)[0]
    if record < 12 or start + record * points > size:
        raise ValueError("the file is shorter than its header says")
    return Header(start, record, points, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155))


def read_points(path: str, h: Header, lo: int, hi: int) -> np.ndarray:
    """Points lo to hi as float64 (n, 3): the product is rounded before the offset is added."""
    kind = np.dtype({"names": ["p"], "formats": ["(3,)<i4"], "offsets": [0], "itemsize": h.record})
    with opened(path) as f:
        raw = np.frombuffer(f.read_at((hi - lo) * h.record, h.start + lo * h.record), kind)["p"]
    scaled = raw.astype(np.float64) * np.array(h.scale)
    return scaled + np.array(h.offset)


@dataclass
class Points(InputPartition):
    lo: int
    hi: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.scene = options.get("scene", self.path)
        with opened(self.path) as f:
            self.header = parse_header(f.read_at(min(375, f.size()), 0), f.size())
        self.points = int(options.get("pointsPerPartition", "1000000"))

    def partitions(self):
        return [Points(a, b) for a, b in ranges(self.header.points, self.points)]

    def read(self, partition: Points):
        for lo, hi in ((a + partition.lo, b + partition.lo) for a, b in ranges(partition.hi - partition.lo, 100_000)):
            xyz = read_points(self.path, self.header, lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array([self.scene] * (hi - lo)), pa.array(np.arange(lo, hi)), *(pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3))], names=["scene", "point_id", "x", "y", "z"])


class LasSource(DataSource):
    """Options: path, scene, pointsPerPartition."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(self.options)
