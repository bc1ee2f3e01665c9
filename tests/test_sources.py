import sqlite3
import struct

import numpy as np
import pytest

from terralign.operators import encode
from terralign.sources import dumps, envi, las, logs, trace


def write_envi(folder, cube, interleave="bsq", kind="<f4", offset=0):
    number = {v: k for k, v in envi.TYPES.items()}[kind[1:]]
    order = {"bsq": (0, 1, 2), "bil": (1, 0, 2), "bip": (1, 2, 0)}[interleave]
    (folder / "r.dat").write_bytes(b"\0" * offset + np.ascontiguousarray(cube.transpose(order)).astype(kind).tobytes())
    (folder / "r.hdr").write_text(f"ENVI\nsamples = {cube.shape[2]}\nlines   = {cube.shape[1]}\nbands = {cube.shape[0]}\nheader offset = {offset}\ndata type = {number}\ninterleave = {interleave}\nbyte order = {int(kind[0] == '>')}\nmap info = {{UTM, 1, 1}}\n")
    return str(folder / "r.dat")


@pytest.mark.parametrize("layout,kind,offset", [("bsq", "<f4", 0), ("bil", ">f4", 16), ("bip", "<i2", 0), ("bsq", "<f8", 3)])
def test_envi_round_trip(spark, tmp_path, layout, kind, offset):
    cube = np.arange(4 * 5 * 3).reshape(4, 5, 3).astype(float)
    path = write_envi(tmp_path, cube, layout, kind, offset)
    logs.register(spark)
    got = spark.read.format("envi").options(path=path, scene="a/b/c", bands="4", rowsPerPartition="2").load()
    assert got.rdd.getNumPartitions() == 3
    rows = got.collect()
    assert len(rows) == 15
    for r in rows:
        assert r.scene == "a/b/c" and r.spectrum == cube[:, r.row, r.col].tolist()


def test_envi_errors(spark, tmp_path):
    path = write_envi(tmp_path, np.zeros((2, 2, 2)))
    with pytest.raises(ValueError):
        envi.EnviReader({"path": path, "bands": "3"})
    for bad in ("lines = 2", "ENVI\nlines = 2\nsamples = 2\nbands = 2\ndata type = 6", "ENVI\nlines = 2\nsamples = 2\nbands = 2\ndata type = 4\ninterleave = x"):
        with pytest.raises(ValueError):
            envi.parse_header(bad)
    (tmp_path / "r.dat").write_bytes(b"\0" * 5)
    with pytest.raises(ValueError):
        envi.read_rows(path, envi.parse_header((tmp_path / "r.hdr").read_text()), 0, 1)


def las_bytes(points, minor=2, form=0, cut=0):
    scale, offset, record = (0.01, 0.02, 0.5), (100.0, -7.0, 0.25), 20
    head = bytearray(375 if minor >= 4 else 227)
    head[:4], head[24], head[25] = b"LASF", 1, minor
    struct.pack_into("<I", head, 96, len(head))
    head[104] = form
    struct.pack_into("<H", head, 105, record)
    struct.pack_into("<I", head, 107, 0 if minor >= 4 else len(points))
    struct.pack_into("<3d", head, 131, *scale)
    struct.pack_into("<3d", head, 155, *offset)
    if minor >= 4:
        struct.pack_into("<Q", head, 247, len(points))
    body = b"".join(struct.pack("<3i8x", *p) for p in points)
    return bytes(head) + (body[:-cut] if cut else body), np.array(points) * np.array(scale) + np.array(offset)


@pytest.mark.parametrize("minor", [2, 4])
def test_las_round_trip(spark, tmp_path, minor):
    raw, xyz = las_bytes([(i, -3 * i, 7 - i) for i in range(11)], minor)
    (tmp_path / "c.las").write_bytes(raw)
    logs.register(spark)
    got = spark.read.format("las").options(path=str(tmp_path / "c.las"), pointsPerPartition="4").load().orderBy("point_id").collect()
    assert [r.point_id for r in got] == list(range(11)) and np.array_equal([[r.x, r.y, r.z] for r in got], xyz)


def test_las_errors():
    for raw in (b"nope" + bytes(300), las_bytes([(1, 2, 3)], form=0x80)[0], las_bytes([(1, 2, 3)], cut=4)[0]):
        with pytest.raises(ValueError):
            las.parse_header(raw[:375], len(raw))


def test_logs_and_sinks(spark, tmp_path):
    (tmp_path / "t.log").write_text("01-02-2024 03:04:05 RAM 10/20MB VDD_IN 300mW tj@41.5C GR3D_FREQ 7%\n01-02-2024 03:04:06 RAM 11/20MB\n01-02-2024 03:04:07 no memory\nRAM 1/2MB\n")
    rows = logs.telemetry_log(spark, str(tmp_path / "t.log")).orderBy("t").collect()
    assert [(r.ram_mb, r.power_mw, r.tj, r.util_pct) for r in rows] == [(10, 300, 41.5, 7), (11, None, None, None)]
    (tmp_path / "p.txt").write_text("idle 1.5 7\nload 8 9.25\n")
    assert [tuple(r) for r in logs.phase_file(spark, str(tmp_path / "p.txt")).collect()] == [("idle", 1.5, 7.0), ("load", 8.0, 9.25)]
    (tmp_path / "w.txt").write_text("K4 0 1.0 2.0\n")
    assert logs.wall_file(spark, str(tmp_path / "w.txt")).first().config == "K4"
    (tmp_path / "j").mkdir()
    (tmp_path / "j/P_s1_fwd.json").write_text('{\n"ms": 3.5\n}')
    r = logs.json_reports(spark, str(tmp_path / "j"), r"([A-Z]\d?)_(s\d)_(fwd|rev)\.json", "ms double").first()
    assert (r.ms, r.config, r.scene, r["round"]) == (3.5, "P", "s1", "fwd")
    (tmp_path / "prof.log").write_text("x\n[I] GPU Compute Time: min = 1 ms, median = 0.25 ms\n")
    assert logs.profiler_medians(spark, str(tmp_path / "prof.log")).first().p50_ms == 0.25
    df = spark.createDataFrame([("a", 1), ("b", None)], "scene string, n int")
    path = logs.cache_scene(df, str(tmp_path / "cache"), "r1")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="already exists"):
        logs.cache_scene(df, str(tmp_path / "cache"), "r1")
    logs.json_report(df, str(tmp_path / "report"))
    assert logs.markdown_table(df.orderBy("scene")) == "| scene | n |\n| - | - |\n| a | 1 |\n| b |  |"
    with pytest.raises(ValueError):
        logs.markdown_table(df, 1)


def stand_in(size, width, seed=5):
    """A fixed random projection with tanh, in a model's place."""

    def make():
        weights = np.random.default_rng(seed).standard_normal((size, width)).astype(np.float32) / np.sqrt(size)
        return lambda x: np.tanh(x @ weights)

    return make


def test_encoder(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.5])], "id int, v array<float>")
    got = {r.id: r.feature for r in encode.encode(encode.checked(df, "v", "array<float>", 2), "v", stand_in(2, 3), batch=2).collect()}
    want = stand_in(2, 3)()(np.array([[1, 2], [0, 0.5]], np.float32))
    assert got[2] is None and np.allclose([got[1], got[3]], want)
    with pytest.raises(TypeError):
        encode.checked(df, "v", "array<double>", 2)
    with pytest.raises(Exception, match="must have 3"):
        encode.checked(df, "v", "array<float>", 3).collect()


def test_sqlite_trace(spark, tmp_path):
    """Read in 8 ranges of rowid, with the time bounds in SQLite."""
    path = str(tmp_path / "t 1.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE NVTX_EVENTS (start INTEGER, end INTEGER, text TEXT, other BLOB)")
    con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_KERNEL (start INT NOT NULL, end INT NOT NULL, x REAL)")
    con.execute("CREATE TABLE CUPTI_ACTIVITY_KIND_MEMCPY (start INT, end INT)")
    con.executemany("INSERT INTO NVTX_EVENTS VALUES (?, ?, ?, ?)", [(10 * k, None if k % 5 == 0 else 10 * k + 8, None if k % 7 == 0 else f"é {k}", b"x") for k in range(1000)])
    con.executemany("INSERT INTO CUPTI_ACTIVITY_KIND_KERNEL VALUES (?, ?, ?)", [(k, k + 3, k / 2) for k in range(5000)])
    con.commit()
    con.close()
    logs.register(spark)
    ranges, device = logs.trace_tables(spark, path)
    assert ranges.rdd.getNumPartitions() == 8
    assert {(r.start, r.stop, r.text) for r in ranges.collect()} == {(10 * k, 10 * k + 8, f"é {k}") for k in range(1000) if k % 5 and k % 7}
    assert device.groupBy("kind").count().collect() == [("kernels", 5000)]
    some, few = logs.trace_tables(spark, path, 1000, 1100)
    assert {r.start for r in some.collect()} == {10 * k for k in range(100, 110) if k % 5 and k % 7}
    assert sorted(r.start for r in few.collect()) == list(range(998, 1100))
    reader = trace.SqliteReader({"path": path, "table": "CUPTI_ACTIVITY_KIND_KERNEL"}, few.sparkSession.createDataFrame([], "start long, end long").schema)
    left = list(reader.pushFilters([trace.GreaterThan(("end",), 4000), trace.LessThan(("start",), 4100), trace.EqualTo(("start", "x"), 1)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4100 - 3998
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan sqlite") == 2 and "Filter (" not in plan  # no filter is left to Spark
    whole = spark.read.format("sqlite").options(path=path, table="NVTX_EVENTS", partitions="3").load()
    assert whole.dtypes == [("start", "bigint"), ("end", "bigint"), ("text", "string"), ("other", "binary")] and whole.count() == 1000
    with pytest.raises(Exception, match="no table"):
        spark.read.format("sqlite").options(path=path, table="none").load().count()


def test_large_dumps_in_pieces(spark, tmp_path):
    """A 200 MB file is read in pieces of 8 MB by tasks that hold 4 MB; small files share a partition; borders are those of rows."""
    n = 5_000_000
    np.arange(n * 10).astype("<f4").tofile(tmp_path / "big.f32")
    logs.register(spark)
    got = logs.raw_dump(spark, str(tmp_path / "big.f32"), row=10, partition_bytes=8 << 20)
    assert got.rdd.getNumPartitions() == 24
    assert got.where("abs(v[0] - 10 * i) <= 2 and size(v) = 10").select("i").distinct().count() == n  # floats of 24 bits
    (tmp_path / "many").mkdir()
    for k in range(30):
        np.full(3 * (k % 4), k, ">i2").tofile(tmp_path / f"many/{k:02}.bin")
    (tmp_path / "many/_ignored").write_bytes(b"1")
    small = logs.raw_dump(spark, str(tmp_path / "many"), ">i2", 3, partition_bytes=60)
    assert small.rdd.getNumPartitions() == 5  # of 44 rows of 6 bytes
    rows = small.collect()
    assert sorted((r.file[-6:-4], r.i, tuple(r.v)) for r in rows) == [(f"{k:02}", i, (k, k, k)) for k in range(30) for i in range(k % 4)]
    with pytest.raises(ValueError):
        dumps.dealt([("x", 7)], 4, 100)


def test_dumps_traces_and_cache(spark, tmp_path):
    logs.register(spark)
    np.arange(6, dtype="<f4").tofile(tmp_path / "a.bin")
    got = logs.raw_dump(spark, str(tmp_path / "a.bin"), row=3).orderBy("i").collect()
    assert [r.v for r in got] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]
    with pytest.raises(Exception, match="rows of 4"):
        logs.raw_dump(spark, str(tmp_path / "a.bin"), row=4).collect()
    for name, cols in (("ranges", "start long, end long, text string"), ("kernels", "start long, end long"), ("memcpys", "start long, end long")):
        row = (1, 9, "step") if name == "ranges" else (2, 4)
        spark.createDataFrame([row], cols).write.parquet(f"{tmp_path}/trace/{name}.parquet")
    spans, device = logs.trace_tables(spark, f"{tmp_path}/trace")
    assert spans.first().text == "step" and sorted(r.kind for r in device.collect()) == ["kernels", "memcpys"]
    logs.cache_scene(spark.createDataFrame([("a", 1)], "scene string, n int"), f"{tmp_path}/c", "r")
    assert logs.load_scene(spark, f"{tmp_path}/c").first().scene == "a"
