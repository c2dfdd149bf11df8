"""Hard negatives and exact products against plain Python."""

import random
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives, topk, whole


def plain(rows, every=50, low=50, high=95):
    """rows: vec_id, label, vector of whole numbers."""
    rows = [r for r in rows if None not in r]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    held = lambda v: min(max(v, whole.LEAST), whole.MOST)
    out = []
    for a in sorted({r[0] for r in rows if r[0] % every == 0}):
        _, label, v = min(r for r in rows if r[0] == a)
        alike = sorted(((dot(v, r[2]), r[0]) for r in rows if r[1] == label and r[0] != a), key=lambda x: (-x[0], x[1]))[:5]
        for score, p in alike:
            able = sorted(((dot(v, r[2]), r[0]) for r in rows if r[1] != label), key=lambda x: (-x[0], x[1]))
            able = [x for x in able if low * score <= 100 * x[0] <= high * score][:3]
            out += [(a, p, k + 1, n, held(score), held(s)) for k, (s, n) in enumerate(able)]
    return sorted(out)


def mined(spark, rows, n=3):
    df = spark.createDataFrame([(i, k, None if v is None else [float(x) for x in v]) for i, k, v in rows], "vec_id long, label int, v array<double>")
    df = df.withColumns({"u": F.lit("u"), "list": F.lit(1), "anchor_id": F.lit(2), "score": F.lit(0)}).repartition(n)
    return sorted(tuple(r) for r in negatives.mine(df).collect())


def made(n=700, width=6, seed=2, spread=9):
    rng = random.Random(seed)
    centre = [[rng.randrange(-40, 40) for _ in range(width)] for _ in range(5)]
    return [(k, rng.randrange(4), [c + rng.randrange(-spread, spread) for c in rng.choice(centre)]) for k in range(n)]


@pytest.mark.parametrize("spread", [2, 30])
def test_mine(spark, spread):
    rows = made(spread=spread)
    assert mined(spark, rows) == plain(rows)


def test_blocks_and_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "VISITS", 3)
    rows = [(i, 0 if i % 3 else k, v) for i, k, v in made(500, 3, 5, 3)]  # ties, and a label of most rows
    assert mined(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    assert mined(spark, [], 1) == []
    assert mined(spark, [(50, 1, [1, 2])], 1) == []
    rows = made(150, 3) + [(50, 1, [3, 3, 3]), (50, 0, [9, 9, 9]), (50, 0, [9, 9, 9]), (7, 2, [9, 9, 9]), (7, 2, [9, 9, 9]), (100, 3, []), (200, 1, [5]), (0, 0, [0, 0, 0])]
    rows += [(None, 1, [1, 1, 1]), (300, None, [1, 1, 1]), (350, 1, None)]
    assert mined(spark, rows) == plain(rows)


def test_components_of_any_size(spark):
    rng = random.Random(6)
    rows = [(k, k % 3, [int(rng.choice([-1, 1]) * 2.0 ** rng.randrange(90, 101)) * rng.randrange(1, 5), rng.randrange(-5, 5), int(3e30)]) for k in range(120)]
    rows += [(200 + k, k % 3, [rng.randrange(-50, 50) for _ in range(3)]) for k in range(60)]
    assert mined(spark, rows) == plain(rows)


def test_whole_numbers(spark):
    held = [[1.5, -1.5], [3e30, 1.0], [None, 1.0], [float("nan")], [float("inf")], None, [], [1e308, 1.0], [2.0**60, -(2.0**60) - 1]]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in held], "v array<double>").coalesce(1).select(whole.whole_numbers(F.col("v"), 256)).collect()]
    assert got == [None if v is None or any(x is None or not isfinite(x * 256) for x in v) else [float(floor(x * 256)) for x in v] for v in held]


def test_products_and_columns():
    rng = np.random.default_rng(1)
    a, b = np.floor(rng.normal(size=(7, 4)) * 1000), np.floor(rng.normal(size=(9, 3)) * 1000)
    assert (whole.products(a, b) == a[:, :3] @ b.T).all()
    a[2] *= 2.0**80
    b[5] *= -(2.0**90)
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=False)) for v in b] for u in a]
    assert whole.products(a, b).tolist() == want
    values = sorted({w for row in want for w in row} | {whole.LEAST, whole.MOST, whole.LEAST - 1, whole.MOST + 1, 0, 5, -5})
    score, beyond = (c.to_pylist() for c in whole.as_columns(values))
    assert sorted(zip(score, beyond, strict=True)) == list(zip(score, beyond, strict=True))
    assert [whole.from_columns(*x) for x in zip(score, beyond, strict=True)] == values
    assert whole.dense(pa.array([[1.0], [], [2.0, 3.0]], pa.list_(pa.float64()))).tolist() == [[1, 0], [0, 0], [2, 3]]


@pytest.mark.parametrize("width", [3, 12])
def test_topk_of_components_of_any_size(spark, width):
    rng = random.Random(8)
    rows = {k: [rng.choice([-1, 1]) * int(3e30) if rng.random() < 0.5 else rng.randrange(-900, 900) for _ in range(width)] for k in range(300)}
    rows |= {k: [rng.randrange(-900, 900) for _ in range(width)] for k in range(300, 500)}
    rows |= {600: [int(1e300)] * width, 601: [-int(1e300)] * width, 700: [1]}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "vec_id long, v array<double>").repartition(3)
    got = {}
    for r in topk.search(df, df.filter("vec_id % 50 = 0"), wave=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, found in got.items():
        score = sorted((-sum(a * b for a, b in zip(rows[q], v, strict=False)), k) for k, v in rows.items() if k != q)[:10]
        assert sorted(found) == [(i + 1, k, max(whole.LEAST, min(whole.MOST, -s))) for i, (s, k) in enumerate(score)], q
    assert set(got) == {k for k in rows if k % 50 == 0}


def test_topk_evaluates_few(spark):
    """Most candidates are ruled out by their bounds: rows near a space of few dimensions."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 24)) + 0.05 * rng.normal(size=(3000, 24))))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, v array<double>").repartition(3)
    taken = spark.sparkContext.accumulator(0)
    found = topk.search(df, df.filter("vec_id % 100 = 0"), n_pivots=12, evaluated=taken).collect()
    assert taken.value < 0.1 * 30 * 2999
    s = x[::100] @ x.T
    for r in found:
        assert r["score"] == s[r["query_id"] // 100, r["vec_id"]]
    for j in range(30):
        s[j, 100 * j] = -np.inf
        assert sorted(r["score"] for r in found if r["query_id"] == 100 * j) == sorted(np.sort(s[j])[-10:].astype(int).tolist())


def test_topk_refuses_what_float64_does_not_hold(spark):
    df = spark.createDataFrame([(100, [(1 << 53) + 1])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="float64"):
        topk.search(df, df).collect()
