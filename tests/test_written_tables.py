"""Appends with continuing offsets, the keyed cache, and writes that count what goes by."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.sources import cache, ragged, tables


def images(spark, sizes, first=0):
    rows = [(first + k, [float(k)] * n, f"s{k}") for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "row long, px array<double>, source string").repartition(3)


def table_of(spark, folder):
    return [(r["number"], r["start"], r["stop"], r["row"], r["append"], len(r["px"])) for r in ragged.read_ragged(spark, folder).orderBy("number").collect()]


def test_appends(spark, tmp_path):
    folder = str(tmp_path / "ragged")
    assert ragged.read_ragged(spark, folder) is None
    a, b = [3, 0, 5, 1], [2, 7]
    assert ragged.appended(images(spark, a), folder, "a", per_file=1)
    assert not ragged.appended(images(spark, a), folder, "a")  # a retry
    images(spark, [9, 9, 9]).write.parquet(f"{folder}/data/append=b")  # a try of b that broke off
    want = [(0, 0, 3, 0, "a", 3), (1, 3, 3, 1, "a", 0), (2, 3, 8, 2, "a", 5), (3, 8, 9, 3, "a", 1)]
    assert table_of(spark, folder) == want
    assert ragged.appended(images(spark, b, 10), folder, "b")
    assert ragged.appended(images(spark, []), folder, "none")
    assert ragged.appended(images(spark, [4], 3), folder, "c")
    want += [(4, 9, 11, 10, "b", 2), (5, 11, 18, 11, "b", 7), (6, 18, 22, 3, "c", 4)]
    assert table_of(spark, folder) == want
    with pytest.raises(ValueError, match="name"):
        ragged.appended(images(spark, a), folder, "a/b")
    with pytest.raises(ValueError, match="columns"):
        ragged.appended(images(spark, a).withColumn("number", F.lit(1)), folder, "d")
    spark.createDataFrame([("x", 1, 1, 3, 3)], ragged.MANIFEST).write.parquet(f"{folder}/manifest/x")  # another writer's
    with pytest.raises(ValueError, match="follow"):
        ragged.read_ragged(spark, folder)


def test_cache(spark, tmp_path):
    source, folder = str(tmp_path / "source"), str(tmp_path / "cache")
    spark.range(5).write.parquet(source)
    made = lambda: spark.read.parquet(source).select((F.col("id") * 2).alias("v"))
    total = lambda df: df.agg(F.sum("v")).first()[0]
    names = lambda: {r["name"] for r in cache.index(spark, folder).collect()}
    assert total(cache.reused(made(), folder)) == total(cache.reused(made(), folder)) == 20 and len(names()) == 1
    spark.range(5, 7).write.mode("append").parquet(source)  # changed input
    assert total(cache.reused(made(), folder)) == 42 and len(names()) == 2
    assert total(cache.reused(spark.read.parquet(source).select((F.col("id") * 3).alias("v")), folder)) == 63 and len(names()) == 3
    assert total(cache.reused(made(), folder, "2")) == 42 and len(names()) == 4
    # a second writer of the same table
    key = cache.index(spark, folder).filter(F.col("key").endswith("-2")).first()
    made().write.parquet(f"{folder}/tables/0")
    spark.createDataFrame([(key["key"], "0")], "key string, name string").write.mode("append").parquet(f"{folder}/index")
    assert total(cache.reused(made(), folder, "2")) == 42
    assert cache.reused(spark.range(3).toDF("v"), folder).count() == 3


def test_counts_of_what_is_written(spark, tmp_path):
    rows = spark.range(30).select((F.col("id") % 3).cast("string").alias("size"), "id")
    path = str(tmp_path / "sizes")
    assert tables.write_parts(rows, path, "size", ["0", "1", "2"], {"0": 10, "2": 10}) == {"0": 10, "1": 10, "2": 10}
    assert spark.read.parquet(f"{path}/size=1").count() == 10
    with pytest.raises(AssertionError, match="others"):
        tables.write_parts(rows, path, "size", ["0", "1"], force=True)
    with pytest.raises(AssertionError, match="not"):
        tables.write_parts(rows, path, "size", ["0", "1", "2"], {"0": 9}, force=True)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_parts(rows, path, "size", ["0", "1", "2"])
    tables.write_checked(rows, str(tmp_path / "one"), 30)
    with pytest.raises(AssertionError, match="30 rows, not 31"):
        tables.write_checked(rows, str(tmp_path / "one"), 31)


def test_ranks_read_their_rows_once(spark):
    rows = spark.createDataFrame([(k, float(k % 7) if k % 5 else None) for k in range(200)], "k long, v double")
    got = {r["k"]: r["r"] for r in ranking.value_ranks(rows, "v", "r").collect()}
    known = sorted(float(k % 7) for k in range(200) if k % 5)
    mean = {v: (known.index(v) + 1 + len(known) - known[::-1].index(v)) / 2 for v in known}
    assert got == {k: mean[float(k % 7)] if k % 5 else None for k in range(200)}
