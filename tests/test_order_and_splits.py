"""The order of tiles, held-out rows, scaled pixels and counted quantiles."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.operators import ranking, sampling, tiles


def test_order_check(spark, monkeypatch):
    rows = [(e, w, t, float(1 + (w * 7 + t) % 5)) for e in range(2) for w in range(0, 36, 5) for t in range(0, 32, 3)]
    pixels = spark.createDataFrame(rows, "event_id long, wire long, t long, adc double")
    got = {(r["event_id"], r["tile_index"]): r["charge"] for r in tiles.order_check(pixels, (18, 16), shape=(36, 32)).collect()}
    want = {}
    for e, w, t, v in rows:
        at = e, (w // 18) * 2 + t // 16
        want[at] = want.get(at, 0) + v
    assert got == want
    real = tiles.catalog
    monkeypatch.setattr(tiles, "catalog", lambda *a, **k: real(*a, **k).withColumn("tile_index", (F.lit(3) - F.col("tile_index")).cast("long")))
    with pytest.raises(Exception, match="order of 18x16 tiles"):
        tiles.order_check(pixels, (18, 16), shape=(36, 32)).collect()
    outside = spark.createDataFrame([(0, 40, 2, 1.0)], pixels.schema)
    with pytest.raises(Exception, match="order of 18x16 tiles"):
        tiles.order_check(outside, (18, 16), shape=(36, 32)).collect()


def test_held_out(spark):
    rows = spark.range(200).select((F.col("id") * 3).alias("k"), F.lit("x").alias("other"))
    test = sorted(r["k"] for r in sampling.split(rows, "k").filter("split = 'test'").collect())
    got = sampling.held_out(rows, "k").orderBy("place").collect()
    assert [r["k"] for r in got] == test and [r["place"] for r in got] == list(range(len(test))) and got[0]["other"] == "x"


def test_scaled(spark):
    df = spark.createDataFrame([([0, 51, 255],), ([],), (None,)], "px array<int>").select(P.scaled(F.col("px")).alias("px"), P.scaled(F.col("px"), 5, "int").alias("whole"))
    assert df.schema["px"].dataType.simpleString() == "array<float>"
    assert [(r["px"] and [round(v, 6) for v in r["px"]], r["whole"]) for r in df.collect()] == [([0.0, 0.2, 1.0], [0, 10, 51]), ([], []), (None, None)]


def test_counted_quantiles(spark):
    df = spark.createDataFrame([(k % 2, float(k) if k % 7 else None) for k in range(40)], "g int, v double")
    got = {r["g"]: (r["value"], r["n"]) for r in ranking.quantiles(df, "v", (0.5,), ("g",), counted=True).collect()}
    for g in range(2):
        own = sorted(float(k) for k in range(40) if k % 2 == g and k % 7)
        middle = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
        assert got[g] == (middle, len(own))
    assert "n" not in ranking.quantiles(df, "v", (0.5,), ("g",)).columns
