import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.sources import tables
from tessera.streaming import monitor


@pytest.mark.parametrize(("w", "h", "n"), [(18, 16, 367201), (64, 32, 2492401), (864, 64, 66789361)])
def test_parameter_counts(w, h, n):
    assert models.parameter_count(w, h) == n and len(models.LAYERS) == 18


def test_autoencoder_shape_and_sign(spark):
    weights = models.initial_weights(6, 4)
    x = np.random.default_rng(0).random((3, 6, 4)).astype(np.float32)
    out = models.reconstruct(weights, x)
    assert out.shape == x.shape and (out >= 0).all()
    rows = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "row long, px array<float>")
    found = {r["row"]: r for r in models.autoencoder_scores(rows, weights, (6, 4)).collect()}
    assert found[1]["raw"] == pytest.approx(((x[1] - out[1]) ** 2).mean(), rel=1e-5) and found[1]["inten"] == pytest.approx(x[1].sum(), rel=1e-5)
    again = tables.load_weights(tables.weights_table(spark, weights))
    assert all((again[k] == v).all() for k, v in weights.items())


def test_convolution_equals_loops():
    rng = np.random.default_rng(1)
    x, w = rng.random((2, 5, 4, 3)), rng.random((3, 3, 3, 2))
    out = models.conv(x, w, np.zeros(2))
    pad = np.pad(x, ((0, 0), (1, 1), (1, 1), (0, 0)))
    want = sum(pad[:, i : i + 5, j : j + 4] @ w[i, j] for i in range(3) for j in range(3))
    assert np.allclose(out, want)


def test_linear_autoencoder(spark):
    rng = np.random.default_rng(2)
    x = rng.random((50, 2)) @ rng.random((2, 6))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row long, px array<double>")
    assert models.linear_scores(models.linear_autoencoder(rows, 6), rows).agg(F.max("raw")).first()[0] == pytest.approx(0, abs=1e-9)


def test_tables(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.range(5).select(F.col("id").alias("event_id"), (F.col("id") / 3).alias("x"))
    tables.write(df, a)
    tables.write(df.limit(1), a)  # kept
    both, status = tables.read_files(spark, [b, a])
    assert both.count() == 5 and {tuple(r) for r in status.collect()} == {(a, "processed"), (b, "missing")} and both.first()["file_id"] == 0
    with pytest.raises(FileNotFoundError):
        tables.read_files(spark, [a, b], missing="error")
    assert tables.events(both, 1, 3).count() == 2
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c")).agg(F.max("x")).first()[0] == pytest.approx(1.33333)
    assert tables.cached(spark, b, lambda: df.limit(2)).count() == 2 == tables.cached(spark, b, lambda: df).count()
    with pytest.raises(FileExistsError):
        tables.write_each({"z": df, "b": df}, str(tmp_path))
    assert not tables.readable(spark, str(tmp_path / "z"))
    assert "| event_id | bigint |" in tables.data_dictionary(df)
    with pytest.raises(ValueError, match="one of"):
        tables.open_variant(df, "other")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"), (F.col("id") * 37 % 3456).alias("wire"), (F.col("id") * 11 % 640).alias("t"), F.lit(1.0).alias("adc"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = monitor.tile_charges(stream).writeStream.outputMode("complete").format("memory").queryName("tile_charges").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = monitor.tile_charges(rows)
    assert sorted(map(tuple, spark.table("tile_charges").collect())) == sorted(map(tuple, want.collect()))
