"""Near-duplicate embeddings by an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralign.llm.common import checkpointed, components, written

#: Rounding allowance for distances and for the first, single-precision pass.
SLACK = 1e-5


def _units(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pack(vector: Column) -> Column:
    """The components as little-endian doubles; null for vectors that are null, empty, zero or not finite, or hold a null."""

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None or not len(v):
                return None
            x = np.asarray(v, dtype=float)  # a null component turns into nan
            # scaling first keeps the squares of huge and tiny components finite
            if not np.isfinite(x).all() or not x.any():
                return None
            return (x / np.abs(x).max() + 0.0).astype("<f8").tobytes() if not 1e-100 < np.abs(x).max() < 1e100 else (x + 0.0).astype("<f8").tobytes()

        return vectors.map(one, na_action="ignore")

    return packed(vector)


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """n vectors of those given, by least hash: a sample that depends on the vectors alone."""
    rows = vectors.orderBy(F.xxhash64("v"), "v").limit(n).collect()
    return _units([bytes(r["v"]) for r in rows], len(rows[0]["v"]) // 8)


def cells(vectors: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """vectors with home (nearest pivot) and away: the other cells that may hold a vector within radius.

    If x has home i and d(x, y) <= radius, then d(y, i) <= d(x, i) + radius and
    d(x, i) <= d(x, h) for y's home h, so by the triangle inequality
    d(y, i) <= d(y, h) + 2 radius. For points of a sphere the same inequality,
    squared, bounds the distance to the plane between the two pivots:
    d(y, i)^2 - d(y, h)^2 <= 2 radius d(i, h). The second is the tighter one.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        between = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _units(part.column(1).to_pylist(), p.shape[1])
                d = np.maximum(2 - 2 * (x @ p.T), 0)
                home = d.argmin(axis=1)
                gap = d - d[np.arange(len(d)), home][:, None]
                near = gap <= 2 * radius * between[home] + SLACK
                near[np.arange(len(d)), home] = False
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32()), pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32()))], names=["id", "v", "n", "home", "away"])

    return vectors.select("id", "v", "n").mapInArrow(assign, "id long, v binary, n long, home int, away array<int>")


def _dense(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) whose cosine in double precision is least or more; single precision rules out the rest."""
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(least - SLACK))
    keep = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], y[j[a : a + 65536]]) >= least for a in range(0, max(len(i), 1), 65536)])
    return i[keep], j[keep]


class Cell:
    """The home vectors of one cell, against which its own and the visiting vectors are held one batch after another."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, least: float):
        self.ids, self.n, self.x, self.least = ids, n, x, least
        self.links = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give home rows a[k] and b[k] one label; every label is the least row of its group."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def meet(self, ids: np.ndarray, n: np.ndarray, y: np.ndarray, offset: int | None = None) -> Iterator[tuple[int, int, int]]:
        """Rows (id, links, partner): what each visitor found. With offset, the visitors are home rows from there on, and each pair counts once."""
        found = np.zeros(len(ids), np.int64)
        first = np.full(len(ids), -1)
        for lo in range(0, len(self.ids), 1024):
            if offset is not None and lo > offset + len(ids):
                break
            i, j = _dense(self.x[lo : lo + 1024], y, self.least)
            i = i + lo
            if offset is not None:
                keep = i < j + offset
                i, j = i[keep], j[keep]
            np.add.at(self.links, i, n[j])
            np.add.at(found, j, self.n[i])
            if offset is None:  # home rows that share a visitor belong together
                order = np.argsort(j, kind="stable")
                same = np.diff(j[order]) == 0
                self.merge(i[order][1:][same], i[order][:-1][same])
            else:
                self.merge(i, j + offset)
            first[j] = i
        for k in np.flatnonzero(found):
            yield int(ids[k]), int(found[k]), int(self.ids[first[k]])

    def rest(self) -> Iterator[tuple[int, int, int]]:
        """Rows of the home vectors: links found, and a vector of the same local group."""
        for k in np.flatnonzero((self.links > 0) | (self.label != np.arange(len(self.label)))):
            yield int(self.ids[k]), int(self.links[k]), int(self.ids[self.label[k]])


def range_join(vectors: DataFrame, least: float, cell_rows: int = 8192, max_pivots: int = 4096) -> DataFrame:
    """Links among distinct vectors (id, v, n: how many rows it stands for): rows (id, links, partner).

    Summed by id, links is the number of rows within reach of the vector, its own
    copies aside; the edges (id, partner) join every linked component. Each pair is
    met once, in the home cell of smaller number. Cells of more than cell_rows home
    vectors are cut, and their own and visiting vectors sent to each part; a task
    holds one part and streams the rest past it, so its memory does not grow.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    total = vectors.count()
    schema = "id long, links long, partner long"
    if not total:
        return vectors.sparkSession.createDataFrame([], schema)
    placed = written(cells(vectors, choose_pivots(vectors, min(max_pivots, -(-total // cell_rows))), radius))
    # at most max_pivots counts come to the driver
    parts = {r["home"]: -(-r["c"] // cell_rows) for r in placed.groupBy("home").agg(F.count("*").alias("c")).collect()}
    cut = F.create_map(*[F.lit(x) for kv in sorted(parts.items()) for x in kv])
    own = placed.select("id", "v", "n", F.col("home").alias("cell"), F.pmod(F.xxhash64("id"), F.get(F.array(cut[F.col("home")]), F.lit(0))).cast("int").alias("block"))
    home = own.select("*", F.col("block").alias("part"), F.lit(0).alias("visits"))
    sibling = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("block")))).where("part < block").withColumn("visits", F.lit(1))
    guest = placed.select("id", "v", "n", F.explode(F.filter("away", lambda c: c < F.col("home"))).alias("cell"), F.lit(-1).alias("block"))
    guest = guest.where(F.array_contains(F.lit(sorted(parts)), F.col("cell"))).withColumn("part", F.explode(F.sequence(F.lit(0), cut[F.col("cell")] - 1))).withColumn("visits", F.lit(1))
    dealt = home.unionByName(sibling).unionByName(guest).repartition("cell", "part").sortWithinPartitions("cell", "part", "visits", "id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        cell: Cell | None = None
        at = None

        def out(rows) -> pa.RecordBatch:
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["id", "links", "partner"])

        def opened():
            """Home rows are complete: hold them against each other."""
            ids, n, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            made = Cell(ids, n, x, least)
            rows: list = []
            for lo in range(0, len(ids), 1024):
                rows += made.meet(ids[lo : lo + 1024], n[lo : lo + 1024], x[lo : lo + 1024], offset=lo)
            return made, rows

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in ("cell", "part", "visits")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                here = tuple(key[lo, :2])
                if here != at:
                    if held and cell is None:
                        cell, rows = opened()
                        yield out(rows)
                    if cell is not None:
                        yield out(cell.rest())
                    held, cell, at = [], None, here
                part = batch.slice(lo, hi - lo)
                raw = part.column("v").to_pylist()
                ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
                x = _units(raw, len(raw[0]) // 8)
                if key[lo, 2] == 0:
                    held.append((ids, n, x))
                    continue
                if not held:
                    continue  # no home vectors in this part
                if cell is None:
                    cell, rows = opened()
                    yield out(rows)
                for a in range(0, len(ids), 1024):
                    yield out(cell.meet(ids[a : a + 1024], n[a : a + 1024], x[a : a + 1024]))
        if held and cell is None:
            cell, rows = opened()
            yield out(rows)
        if cell is not None:
            yield out(cell.rest())

    return dealt.select("cell", "part", "visits", "id", "n", "v").mapInArrow(joined, schema)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per row of df: key, n_links, component (smallest key reachable by links, its own included), kept.

    Vectors link whose cosine, in double precision, is least or more. Null, empty
    and zero vectors, those with null or non-finite components, and those of another
    length than most link with nothing. Equal vectors link with each other and are
    compared once. Rows with equal keys and vectors count as rows; an empty table
    gives no rows; a null key never links; a key column without integers raises;
    other columns are ignored.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must hold integers: the smallest stands for its group")
    rows = written(df.select(F.col(key).cast("long").alias("id"), pack(F.col(vector).cast(T.ArrayType(T.DoubleType()))).alias("v")))
    lengths = rows.where("v is not null").groupBy(F.length("v").alias("l")).count().orderBy(F.desc("count"), "l").first()
    good = rows.where((F.length("v") == (lengths["l"] if lengths else 0)) & F.col("id").isNotNull())
    classes = written(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    found = checkpointed(range_join(classes.select(F.col("rep").alias("id"), "v", "n"), least))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("partner").alias("b")))
    told = classes.join(links, classes["rep"] == links["id"], "left").drop("id").join(roots, F.col("rep") == roots["node"], "left")
    told = told.select(F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = good.join(told, good["v"] == told["_v"]).select("id", "n_links", "component")
    odd = rows.where(F.coalesce(F.length("v") != (lengths["l"] if lengths else 0), F.lit(True)) | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.unionAll(odd).select(F.col("id").alias(key), "n_links", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all embeddings at cosine 0.9."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")
