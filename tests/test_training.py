"""Networks, their gradients, training, checkpoints and codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models, training


def tiles(w, h, n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, w, h), np.float32)
    for k in range(n):
        at = rng.integers(0, w - 2), rng.integers(0, h - 2)
        x[k, at[0] : at[0] + 3, :] = 0.2 * (1 + k % 3)
        x[k, :, at[1]] += 0.5
    return x.reshape(n, -1)


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "row long, px array<double>").repartition(3, "row")


@pytest.mark.parametrize("kind", ["conv", "dense"])
def test_gradients_equal_finite_differences(kind):
    if kind == "conv":
        network, v = training.convolutional(6, 4), models.initial_weights(6, 4, 1)
    else:
        network, v = training.dense((24, 5, 24)), models.dense_weights((24, 5, 24), 1)
    rng = np.random.default_rng(0)
    x = rng.random((3, 24))
    v = {k: a.astype(np.float64) + (0.05 * rng.random(a.shape) if k.startswith("bias") else 0) for k, a in v.items()}
    if kind == "dense":
        x = x.astype(np.float32)
    found, loss = network.gradients(v, x)
    total = lambda w: network.gradients(w, x)[1]
    assert loss == pytest.approx(((network.reconstruct(v, x).reshape(3, -1) - x) ** 2).mean(axis=1).sum(), rel=1e-5)
    for name, a in v.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in a.shape)
            step = 1e-5 if kind == "conv" else 1e-3
            up, down = ({**v, name: a.copy()} for _ in range(2))
            up[name][at] += step
            down[name][at] -= step
            assert found[name][at] == pytest.approx((total(up) - total(down)) / (2 * step), rel=2e-3, abs=1e-5), name


@pytest.mark.parametrize(("w", "h"), [(8, 8), (18, 16)])
def test_loss_falls(spark, w, h):
    x = tiles(w, h, 60)
    rows = frame(spark, x)
    state = training.train(rows.filter("row % 5 > 0"), training.convolutional(w, h), models.initial_weights(w, h, 2), 8, 2, 1e-3, rows.filter("row % 5 = 0"))
    losses = [v for _, v in state.losses]
    assert state.step == 16 and losses[-1] < 0.8 * losses[0]
    best = training.mean_loss(rows.filter("row % 5 = 0"), training.convolutional(w, h), state.best)
    assert best == pytest.approx(min(losses), rel=1e-6)
    scored = training.scored(rows, training.convolutional(w, h), state.best, layers=("pool",)).orderBy("row").collect()
    rec = models.reconstruct(state.best, x.reshape(-1, w, h)).reshape(60, -1)
    assert [r["raw"] for r in scored] == pytest.approx(((rec - x) ** 2).mean(axis=1).tolist(), rel=1e-4)
    assert {len(r["code"]) for r in scored} == {80} and {len(r["pool"]) for r in scored} == {20 * w * h // 4}


def test_steps_share_out_images_of_one_file(spark, monkeypatch):
    """Images that lie in one part are trained on in many tasks, and how they lay makes no difference."""
    plain, parts = training.gradient_sums, []

    def seen(images, *how):
        parts.append(images.select(F.input_file_name().alias("f")).distinct().count())
        return plain(images, *how)

    monkeypatch.setattr(training, "gradient_sums", seen)
    rows, network, start = frame(spark, tiles(4, 4, 1200)), training.convolutional(4, 4), models.initial_weights(4, 4, 3)
    one = training.train(rows.coalesce(1), network, start, 1, 2)
    assert parts == [3, 3]
    many = training.train(rows.repartition(7), network, start, 1, 2)
    assert one.losses == many.losses and all(np.array_equal(one.weights[k], many.weights[k]) for k in start)


def test_resume_gives_the_same_weights(spark, tmp_path):
    rows, network, start = frame(spark, tiles(4, 4, 30)), training.convolutional(4, 4), models.initial_weights(4, 4, 3)
    how = {"steps": 2, "validation": rows.filter("row % 4 = 0")}
    whole = training.train(rows, network, start, 4, **how)
    folder = str(tmp_path / "run")
    training.train(rows, network, start, 2, folder=folder, **how)
    spark.range(0).write.mode("overwrite").parquet(f"{folder}/epoch-3")  # a run that broke off left this
    again = training.train(rows, network, start, 4, folder=folder, **how)
    assert again.losses == whole.losses and again.step == whole.step == 8
    for kind in ("weights", "first", "second", "best"):
        assert all(np.array_equal(getattr(whole, kind)[k], getattr(again, kind)[k]) for k in start)
    assert training.train(rows, network, start, 4, folder=folder).losses == whole.losses  # nothing left to do


def test_without_images(spark):
    state = training.train(frame(spark, tiles(4, 4, 1)).filter("row < 0"), training.convolutional(4, 4), models.initial_weights(4, 4), 2)
    assert state.step == 0 and np.isnan(state.losses[0][0])


def test_code_spread(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) * 1e-3 + 1e4
    group = [k % 3 if k % 3 else None for k in range(200)]
    rows = spark.createDataFrame([(g, [float(v) for v in r]) for g, r in zip(group, x, strict=True)], "label int, code array<double>").repartition(4)
    found = {r["label"]: r for r in training.code_spread(rows, ("label",)).collect()}
    for g in (None, 1, 2):
        own = x[[k for k, v in enumerate(group) if v == g]]
        assert found[g]["n"] == len(own)
        assert np.allclose(found[g]["covariance"], np.cov(own.T, bias=True), rtol=1e-5, atol=1e-12)
        assert found[g]["rms_distance"] == pytest.approx(np.sqrt(own.var(axis=0).sum()), rel=1e-5)
    one = training.code_spread(rows).first()
    assert one["n"] == 200 and one["mean_std"] == pytest.approx(x.std(axis=0).mean(), rel=1e-5)
    network = training.dense((16, 4, 16))
    images = frame(spark, tiles(4, 4, 20)).withColumn("label", F.col("row") % 2)
    codes = training.scored(images, network, models.dense_weights((16, 4, 16)), keep=("label",))
    assert {(r["n"], len(r["mean"])) for r in training.code_spread(codes, ("label",)).collect()} == {(10, 4)}
