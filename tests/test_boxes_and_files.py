"""Summed areas, interval joins and .npy files against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import areas, intervals
from tessera.sources import npy


def test_summed_areas(spark):
    rng = np.random.default_rng(1)
    shape, size = (36, 48), (6, 16)
    images = {e: np.zeros(shape) for e in range(3)}
    rows = []
    for e, image in images.items():
        for _ in range(60 if e else 1):
            w, t, v = int(rng.integers(36)), int(rng.integers(48)), float(rng.integers(1, 9))
            image[w, t] += v
            rows.append((e, w, t, v))
    boxes = [(e, i, *sorted(rng.integers(-3, 42, 2).tolist()), *sorted(rng.integers(-3, 55, 2).tolist())) for e in range(4) for i in range(40 * e, 40 * e + 40)]
    boxes += [(1, 900, 0, 36, 0, 48), (1, 901, 5, 5, 1, 9), (1, 902, 9, 2, 0, 48), (2, 903, 35, 36, 47, 48)]
    p = spark.createDataFrame([*rows, (1, 3, 3, None)], "event_id long, wire long, t long, adc double")
    b = spark.createDataFrame(boxes, "event_id long, row long, wire_lo long, wire_hi long, time_lo long, time_hi long")
    table = areas.summed_areas(p, size=size, shape=shape)
    assert table.count() == 3 * 18
    got = {r["row"]: r["total"] for r in areas.box_sums(table, b, size=size, shape=shape).collect()}
    want = {i: float(images[e][max(a, 0) : max(c, 0), max(x, 0) : max(y, 0)].sum()) if e in images else 0.0 for e, i, a, c, x, y in boxes}
    assert got == want
    with pytest.raises(ValueError, match="fill"):
        areas.summed_areas(p, size=(7, 16), shape=shape)


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("width", [None, 0.7, 1000.0])
def test_overlapping(spark, closed, width):
    rng = np.random.default_rng(2)
    made = lambda n: [(k, k % 2, float(lo), float(lo + rng.choice([0, 1, 3, 40]))) for k, lo in enumerate(rng.integers(-30, 60, n))]
    a, b = made(60), made(50)
    a += [(100, 0, None, 3.0), (101, 0, 5.0, 1.0), (102, 1, 2.0, 2.0)]
    x, y = spark.createDataFrame(a, "ia long, g int, la double, ha double"), spark.createDataFrame(b, "ib long, g int, lb double, hb double")
    rows = intervals.overlapping(x, y, ("la", "lb"), ("ha", "hb"), on=("g",), closed=closed, where=F.col("ia") != F.col("ib"), width=width)
    got = sorted((r["ia"], r["ib"]) for r in rows.collect())
    meets = (lambda p, q: p <= q) if closed else (lambda p, q: p < q)
    whole = lambda r: r[2] is not None and r[2] <= r[3]
    assert got == sorted((p[0], q[0]) for p in a for q in b if whole(p) and p[1] == q[1] and p[0] != q[0] and meets(p[2], q[3]) and meets(q[2], p[3]))
    assert "Cartesian" not in rows._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<i2", "|u1", "<f2", ">i4", "|b1"])
def test_npy_files(spark, tmp_path, dtype):
    x = (np.random.default_rng(3).integers(0, 2 if dtype == "|b1" else 100, (101, 3, 4))).astype(dtype)
    np.save(tmp_path / "x.npy", x)
    rows = npy.read_npy(spark, str(tmp_path / "x.npy"), partition_bytes=10 * x[0].nbytes)
    assert rows.rdd.getNumPartitions() == 11
    got = rows.orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(101)) and np.array_equal(np.array([r["px"] for r in got]), x.reshape(101, -1).astype(np.array(got[0]["px"]).dtype))
    some = npy.read_npy(spark, str(tmp_path / "x.npy"), 7, 9).orderBy("row").collect()
    assert [(r["row"], r["px"]) for r in some] == [(k, got[k]["px"]) for k in (7, 8)]


def test_npy_reads_only_what_is_asked(spark, tmp_path):
    x = np.arange(4000, dtype="<f4").reshape(1000, 4)
    path = tmp_path / "cut.npy"
    np.save(path, x)
    whole = path.read_bytes()
    path.write_bytes(whole[: 128 + 50 * 16])  # the header says 1000 rows, 50 are there
    assert npy.schema_of(str(path)).simpleString() == "struct<row:bigint,px:array<float>>"
    rows = npy.read_npy(spark, str(path), 40, 50)
    assert [r["px"] for r in rows.orderBy("row").collect()] == x[40:50].tolist()
    with pytest.raises(Exception, match="ends before row"):
        npy.read_npy(spark, str(path), 45, 60).collect()
    reader = npy.NpyReader({"path": str(path), "low": "10", "high": "20", "partition_bytes": "64"}, npy.schema_of(str(path)))
    assert [(p.first, p.n) for p in reader.partitions()] == [(10, 4), (14, 4), (18, 2)]


def test_npy_round_trip(spark, tmp_path):
    x = np.random.default_rng(4).random((57, 2, 3)).astype("<f4")
    df = spark.createDataFrame([(k * 3, [float(v) for v in x[k].ravel()]) for k in range(57)], "row long, px array<double>").repartition(5)
    path = str(tmp_path / "out")
    for _ in range(2):  # the second takes the first's place
        npy.write_npy(df, path, (2, 3), rows_per_file=20)
    parts = npy.files(path)
    assert len(parts) == 3 and np.array_equal(np.concatenate([np.load(p) for p in parts]), x)
    assert [r["px"] for r in npy.read_npy(spark, path).orderBy("row").collect()] == x.reshape(57, -1).tolist()
    assert [r["row"] for r in npy.read_npy(spark, path, 15, 45).orderBy("row").collect()] == list(range(15, 45))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = npy.read_npy(spark, path).filter("row >= 50 and row < 52 and px[0] > -1")
        assert [r["row"] for r in found.orderBy("row").collect()] == [50, 51]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="pixels"):
        npy.write_npy(df, path, (2, 2))
    (tmp_path / "no.npy").write_bytes(b"hello world")
    with pytest.raises(ValueError, match="not a .npy"):
        npy.header(str(tmp_path / "no.npy"))
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(ValueError, match="Fortran"):
        npy.header(str(tmp_path / "f.npy"))
