"""Splits, samples and batches that are the same on every run: rows are ranked by a key's hash or an arithmetic one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import value_ranks


def mixed_key(key: Column, seed: int = 0) -> Column:
    """An arithmetic key that any SQL engine computes."""
    return F.pmod(F.pmod(key, F.lit(104729)) * 7919 + seed, F.lit(104729))


def split(df: DataFrame, key: str, ratios: tuple[float, float] = (0.5, 0.1), seed: int = 42) -> DataFrame:
    """df with split: train, val or test by rank of the mixed key (then the key); sizes are rounded half to even."""
    n = df.count()
    a, b = round(n * ratios[0]), round(n * ratios[1])
    order = F.struct(mixed_key(F.col(key), seed).cast("long"), F.col(key))
    ranked = value_ranks(df.withColumn("_o", order), "_o", "_r")
    return ranked.withColumn("split", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "val").otherwise("test")).drop("_o", "_r")


def held_out(df: DataFrame, key: str, ratios: tuple[float, float] = (0.5, 0.1), seed: int = 42) -> DataFrame:
    """df's rows that split() keeps for tests, with place: their number from 0 by ascending key (distinct)."""
    rows = split(df, key, ratios, seed).filter("split = 'test'").drop("split")
    return value_ranks(rows, key, "place").withColumn("place", F.col("place").cast("long") - 1)


def nested_split(df: DataFrame, key: str, test: float = 0.4, val: float = 1 / 6, seed: int = 42) -> DataFrame:
    """Test first, then a share of the rest for validation."""
    return split(df, key, ((1 - test) * (1 - val), (1 - test) * val), seed)


def capped(df: DataFrame, by: list[str], key: str, cap: int = 15, seed: int = 0) -> DataFrame:
    """At most `cap` rows of each group, without replacement: a sampling operator."""
    order = Window.partitionBy(*by).orderBy(mixed_key(F.col(key), seed), key)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap).drop("_r")


def reservoir(df: DataFrame, key: str, n: int = 40, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def batches(df: DataFrame, key: str, size: int = 128) -> DataFrame:
    """df with batch_id: `size` rows of neighbouring keys each, the last may have fewer; equal keys share a batch."""
    return value_ranks(df, key, "_r").withColumn("batch_id", F.floor((F.col("_r") - 1) / size)).drop("_r")


def whole_batches(n: int, size: int) -> int:
    """Rows to evaluate for a cap of n: evaluation stops after the batch that crosses it."""
    return -(-n // size) * size


def pick(df: DataFrame, key: str, row: int | None = None, seed: int = 0) -> DataFrame:
    """One row: that of key `row`, or the one whose hash with the seed is smallest; an empty frame if there is none."""
    return df.filter(F.col(key) == row).limit(1) if row is not None else reservoir(df, key, 1, seed)
