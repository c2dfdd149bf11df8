"""Column expressions on pixels, tiles and labels. Coordinates: wire, t (downsampled tick)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image size in wires and ticks, downsampling, cuts, tile sizes, and the hit classes.
WIRES, TICKS, FACTOR = 3456, 640, 10
CUTOFF, SATURATION = 10, 100
TILE_SIZES = ((864, 64), (64, 32), (18, 16))
HIT_CLASSES = ("cosmic", "other", "muon", "pion", "proton")


def apply_cuts(v: Column, cutoff: float = CUTOFF, saturation: float = SATURATION) -> Column:
    """Below the cutoff 0, above the saturation the saturation; either bound itself is unchanged."""
    return F.when(v < cutoff, F.lit(0).cast("double")).otherwise(F.least(v.cast("double"), F.lit(float(saturation))))


def binarise(v: Column, charge: float = 100) -> Column:
    return F.when(v > 0, F.lit(float(charge))).otherwise(0.0)


def tile_index(wire: Column, t: Column, sw: int, st: int, ticks: int = TICKS) -> Column:
    """wire_block * time_blocks + time_block."""
    return (F.floor(wire / sw) * (ticks // st) + F.floor(t / st)).cast("long")


def tile_row(index: Column, st: int, ticks: int = TICKS) -> Column:
    return F.floor(index / (ticks // st)).cast("long")


def tile_col(index: Column, st: int, ticks: int = TICKS) -> Column:
    return (index % (ticks // st)).cast("long")


def tick_pixel(tick: Column, factor: int = FACTOR) -> Column:
    return F.floor(tick / factor).cast("long")


def hit_charge(integral: Column) -> Column:
    return F.abs(integral)


def scaled_score_training(score: Column, total: Column) -> Column:
    """0 where the image is empty."""
    return F.when(total > 0, F.try_divide(score, total)).otherwise(0.0)


def scaled_score_analysis(score: Column, total: Column) -> Column:
    """Null where the image is empty."""
    return F.when(total > 0, F.try_divide(score, total))


def purity_class(percent: Column) -> Column:
    """0 cosmic at 0 and below, 2 neutrino at 100 and above, 1 mixed between, -1 unknown."""
    return F.when(percent.isNull() | F.isnan(percent.cast("double")), -1).when(percent <= 0, 0).when(percent >= 100, 2).otherwise(1)


def pdg_class(pdg: Column) -> Column:
    """Index into HIT_CLASSES for a depositor's code; of an unmatched hit (null) see truth.hit_class."""
    a = F.abs(pdg)
    return F.when(a == 13, 2).when(a == 211, 3).when(a == 2212, 4).otherwise(1)


def class_name(index: Column) -> Column:
    """Empty for -1 and null."""
    return F.coalesce(F.get(F.array(*map(F.lit, HIT_CLASSES)), index), F.lit(""))


def residual(image: Column, other: Column) -> Column:
    return F.zip_with(image, other, lambda a, b: F.abs(a - b))


def with_noise(px: Column, key: Column, seed: int = 0) -> Column:
    """Adds 10 .. 199 / 255 to every element but the first, clipped at 1; the amount is a hash of key, seed and place."""
    noise = lambda i: (F.pmod(F.xxhash64(key, F.lit(seed), i), F.lit(190)) + 10) / 255
    return F.transform(px, lambda v, i: F.when(i > 0, F.least(F.lit(1.0), v + noise(i))).otherwise(v.cast("double")))


def lit_fraction(px: Column) -> Column:
    return F.try_divide(F.size(F.filter(px, lambda v: v > 0)), F.size(px))


def vertex_distance(dw: Column, dt: Column) -> Column:
    return F.sqrt(dw * dw + dt * dt)


def scaled(px: Column, by: float = 255.0, kind: str = "float") -> Column:
    """Every pixel of an array divided by a number, as another type."""
    return F.transform(px, lambda v: (v / F.lit(float(by))).cast(kind))
