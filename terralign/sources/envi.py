"""ENVI rasters as a data source: spark.read.format("envi").option("path", ...)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terralign.sources.files import opened, ranges

#: ENVI data type numbers and what they stand for (fixed values of the format).
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
SCHEMA = "scene string, row int, col int, spectrum array<float>"


@dataclass(frozen=True)
class Header:
    lines: int
    samples: int
    bands: int
    kind: str
    interleave: str
    offset: int

    @property
    def plain(self) -> bool:
        """Band-sequential little-endian floats from the first byte on: rows of a band are read as they lie."""
        return self.kind == "<f4" and self.interleave == "bsq" and self.offset == 0


def parse_header(text: str) -> Header:
    """The fields of a header that matter; ValueError where one is missing or unknown."""
    if not text.lstrip().startswith("ENVI"):
        raise ValueError("not an ENVI header")
    found = {k.strip().lower(): v.strip() for k, v in re.findall(r"^([^=\n{]+)=\s*([^\n{]*)", text, re.M)}
    try:
        number = {k: int(found[k]) for k in ("lines", "samples", "bands", "data type")}
        kind = TYPES[number["data type"]]
    except KeyError as e:
        raise ValueError(f"ENVI header without a usable {e}") from None
    order = ">" if int(found.get("byte order", "0")) else "<"
    layout = found.get("interleave", "bsq").lower()
    if layout not in ("bsq", "bil", "bip"):
        raise ValueError(f"unknown interleave {layout}")
    return Header(number["lines"], number["samples"], number["bands"], order + kind, layout, int(found.get("header offset", "0")))


def read_rows(path: str, h: Header, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi as float32 (rows, samples, bands)."""
    size = np.dtype(h.kind).itemsize
    with opened(path) as f:
        if f.size() < h.offset + h.lines * h.samples * h.bands * size:
            raise ValueError(f"{path} is shorter than its header says")
        if h.interleave == "bsq":
            out = np.empty((hi - lo, h.samples, h.bands), np.float32)
            for b in range(h.bands):
                at = h.offset + (b * h.lines + lo) * h.samples * size
                out[..., b] = np.frombuffer(f.read_at((hi - lo) * h.samples * size, at), h.kind).reshape(hi - lo, h.samples)
            return out
        block = np.frombuffer(f.read_at((hi - lo) * h.samples * h.bands * size, h.offset + lo * h.samples * h.bands * size), h.kind)
        if h.interleave == "bip":
            return block.reshape(hi - lo, h.samples, h.bands).astype(np.float32)
        return block.reshape(hi - lo, h.bands, h.samples).transpose(0, 2, 1).astype(np.float32)


@dataclass
class Rows(InputPartition):
    lo: int
    hi: int


class EnviReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.scene = options.get("scene", self.path)
        with opened(options.get("header", re.sub(r"\.[^./]*$", "", self.path) + ".hdr")) as f:
            self.header = parse_header(f.read().decode("latin-1"))
        if (want := options.get("bands")) and int(want) != self.header.bands:
            raise ValueError(f"{self.header.bands} bands, expected {want}")
        self.rows = int(options.get("rowsPerPartition", "64"))

    def partitions(self):
        return [Rows(a, b) for a, b in ranges(self.header.lines, self.rows)]

    def read(self, partition: Rows):
        block = read_rows(self.path, self.header, partition.lo, partition.hi)
        for r, line in enumerate(block):
            n = len(line)
            offsets = pa.array(np.arange(n + 1) * self.header.bands, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([self.scene] * n), pa.array(np.full(n, partition.lo + r, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(line.reshape(-1)))], names=["scene", "row", "col", "spectrum"])


class EnviSource(DataSource):
    """Options: path, header (default: path with .hdr), scene, bands (checked), rowsPerPartition."""

    @classmethod
    def name(cls):
        return "envi"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return EnviReader(self.options)
