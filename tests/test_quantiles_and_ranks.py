"""Exact quantiles and ranks without one buffer or hot join keys, against NumPy and pandas."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import histograms, ranking, scores

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice("abc"), rng.choice((0.0, 0.0, 0.0, rng.gauss(0, 5), float(rng.randrange(4)))), rng.random()) for _ in range(1500)] + [("d", 4.0, 1.0), ("e", None, 1.0), (None, 2.0, 0.5), (None, 3.0, None)]
    return spark.createDataFrame(data, "g string, v double, w double").repartition(5).cache()


def test_quantiles(rows):
    pdf = rows.toPandas()
    want = np.quantile(pdf["v"].dropna(), SHARES)
    assert ranking.quantile_values(rows, "v", SHARES) == pytest.approx(want.tolist())
    assert ranking.quantile_values(rows.limit(0), "v", (0.5,)) == [None]


def test_quantiles_by_group(rows):
    pdf = rows.filter("g is not null").toPandas().dropna(subset=["v"])
    found = {(r["g"], r["share"]): r["value"] for r in ranking.quantiles(rows.filter("g is not null"), "v", SHARES, ("g",)).collect()}
    assert set(found) == {(g, s) for g in "abcd" for s in SHARES}
    for g, own in pdf.groupby("g"):
        assert [found[g, s] for s in SHARES] == pytest.approx(np.quantile(own["v"], SHARES).tolist())


@pytest.mark.parametrize("frequent", [10_000, 3])
def test_ranks_with_frequent_values(rows, monkeypatch, frequent):
    """Values that are broadcast and values that are shuffled give the same."""
    monkeypatch.setattr(ranking, "FREQUENT", frequent)
    pdf = rows.toPandas()
    want = sorted(pdf["v"].rank().dropna())
    found = ranking.value_ranks(rows, "v", "r").toPandas()
    assert len(found) == len(pdf) and sorted(found["r"].dropna()) == pytest.approx(want) and found["r"].isna().sum() == 1
    below = ranking.share_below(rows, "v", "b").toPandas().dropna(subset=["v"])
    known = pdf["v"].dropna().to_numpy()
    assert below["b"].to_numpy() == pytest.approx([(known < x).mean() for x in below["v"]])
    both = pdf.dropna(subset=["v", "w"])
    assert ranking.spearman(rows, "v", "w").first()[0] == pytest.approx(both["v"].rank().corr(both["w"].rank()))


def test_value_ranks_replace_a_clashing_column(spark):
    df = spark.createDataFrame([(1, 9), (2, 9)], "a int, r int")
    assert sorted(tuple(x) for x in ranking.value_ranks(df, "a", "r").select("a", "r").collect()) == [(1, 1.0), (2, 2.0)]


def test_medians_and_sweeps(spark, rows):
    found = {r["g"]: (r["v"], r["w"]) for r in scores.medians(rows.filter("g is not null"), ("v", "w"), "g").collect()}
    pdf = rows.toPandas().groupby("g").median()
    assert found["e"] == (None, 1.0)
    assert all(found[g] == pytest.approx((pdf["v"][g], pdf["w"][g])) for g in "abcd")
    clean = spark.createDataFrame([(float(k), False) for k in range(101)], "s double, p boolean")
    named = {r["name"]: r["threshold"] for r in scores.threshold_sweep(clean, "s", F.col("p")).collect()}
    assert named["p95"] == 95 and named["max_clean"] == 100 and "gap_midpoint" not in named
    assert scores.threshold_sweep(clean.limit(0), "s", F.col("p")).count() == 0
    assert scores.threshold_sweep(clean.filter("s < 0"), "s", F.col("p")).columns == scores.threshold_sweep(clean, "s", F.col("p")).columns


def test_quartiles_by_bin(spark):
    rng = np.random.default_rng(0)
    x, y = 10 ** rng.uniform(1, 4, 400), rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    pdf = pd.DataFrame({"bin": np.minimum(np.floor((np.log10(x) - 1) / 0.25), 11).astype(int), "y": y})
    for r in histograms.binned_quartiles(df, "x", "y", 1, 4, 12, F.col("y") > 0).collect():
        own = pdf[pdf["bin"] == r["bin"]]["y"]
        assert (r["n"], r["pass_share"]) == (len(own), pytest.approx((own > 0).mean()))
        assert [r["q25"], r["q50"], r["q75"]] == pytest.approx(np.quantile(own, (0.25, 0.5, 0.75)).tolist())


def test_densities(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=300), rng.normal(5, 0.5, 100)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    found = histograms.density(df, "v", 50).orderBy("bin").collect()
    n, edges = np.histogram(v, 50)
    assert [r["n"] for r in found] == n.tolist()
    assert [r["density"] for r in found] == pytest.approx((n / len(v) / (edges[1] - edges[0])).tolist())
    width = v.std(ddof=1) * len(v) ** -0.2
    for r in histograms.smooth_density(df, "v", 20).collect():
        want = np.exp(-0.5 * ((r["x"] - v) / width) ** 2).sum() / (len(v) * width * (2 * np.pi) ** 0.5)
        assert r["density"] == pytest.approx(want, abs=1e-4)
    assert histograms.smooth_density(df.filter("v is null"), "v").count() == 0
    assert {r["weight"] for r in histograms.equal_weights(df).collect()} == {1 / 401}
    assert histograms.density(df.filter("v is null"), "v").count() == 0
