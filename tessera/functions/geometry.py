"""Detector geometry as column expressions. Lengths in cm; planes 0, 1, 2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wires by plane, ticks, and the active volume's sides.
N_WIRES = (2400, 2400, 3456)
N_TICKS = 6400
ACTIVE = ((0.0, 255.0), (-116.0, 116.0), (10.0, 1036.0))
#: Lines of the wire ends, offset and slope, and their limits; centimetres by tick.
FIRST_ENDS = ((117.153, -0.34641, -115.505), (-115.213, 0.34641, 117.445))
LAST_ENDS = ((715.8006, -0.34640, 117.445), (-713.8606, 0.34640, -115.505))
FIRST_Z, LAST_Z, ACROSS = (-402.941, 0.6, 0.0352608), (0.541, 0.6, 1036.96), (0.25, 0.3)
PLANE_X, UPRIGHT = (0.0, -0.3, -0.6), (-115.53, 117.47)
TICK_OFFSET, TICK_CM = 800, 0.0548965
#: Particle categories; their numbers aren't those of the hit classes.
CATEGORIES = ("pion", "muon", "kaon", "proton", "electron", "michel", "delta", "other", "photon")


def n_wires(plane: Column) -> Column:
    out = F.raise_error(F.lit("there are planes 0, 1 and 2")).cast("int")
    for p, n in enumerate(N_WIRES):
        out = F.when(plane == p, n).otherwise(out)
    return out


def point(x: float, y: Column, z: Column) -> Column:
    return F.struct(F.lit(x).alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def wire_ends(plane: Column, wire: Column) -> tuple[Column, Column]:
    """Both ends (structs of x, y, z); an error for other planes and wires. The slopes of the two ends differ slightly."""
    w = wire.cast("double")
    line = lambda at: F.lit(at[0]) + F.lit(at[1]) * w
    start_z, end_z = F.greatest(line(FIRST_Z), F.lit(FIRST_Z[2])), F.least(line(LAST_Z), F.lit(LAST_Z[2]))
    (a, b), (c, d) = FIRST_ENDS, LAST_ENDS
    starts = (
        point(PLANE_X[0], F.greatest(line(a), F.lit(a[2])), start_z),
        point(PLANE_X[1], F.least(line(b), F.lit(b[2])), start_z),
        point(PLANE_X[2], F.lit(UPRIGHT[0]), line(ACROSS)),
    )
    ends = (
        point(PLANE_X[0], F.least(line(c), F.lit(c[2])), end_z),
        point(PLANE_X[1], F.greatest(line(d), F.lit(d[2])), end_z),
        point(PLANE_X[2], F.lit(UPRIGHT[1]), line(ACROSS)),
    )
    wrong = F.raise_error(F.lit("no such plane or wire")).cast("struct<x:double,y:double,z:double>")
    out = []
    for each in (starts, ends):
        col = wrong
        for p in range(3):
            col = F.when((plane == p) & (wire >= 0) & (wire < N_WIRES[p]), each[p]).otherwise(col)
        out.append(col)
    return out[0], out[1]


def z_overlap(plane_a: Column, a: tuple[Column, Column], plane_b: Column, b: tuple[Column, Column]) -> Column:
    """Whether wires may cross: on different planes, and neither z interval wholly below the other. It isn't an intersection test."""
    lo = lambda w: F.least(w[0]["z"], w[1]["z"])
    hi = lambda w: F.greatest(w[0]["z"], w[1]["z"])
    return (plane_a != plane_b) & ~((hi(a) < lo(b)) | (lo(a) > hi(b)))


def crossing(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """struct (y, z) where the infinite lines of two wires cross in the y-z plane; null if they are parallel."""
    day, daz = a[1]["y"] - a[0]["y"], a[1]["z"] - a[0]["z"]
    dby, dbz = b[1]["y"] - b[0]["y"], b[1]["z"] - b[0]["z"]
    py, pz = -daz, day
    part = F.try_divide(py * (a[0]["y"] - b[0]["y"]) + pz * (a[0]["z"] - b[0]["z"]), py * dby + pz * dbz)
    return F.when(part.isNotNull(), F.struct((part * dby + b[0]["y"]).alias("y"), (part * dbz + b[0]["z"]).alias("z")))


def in_active_volume(x: Column, y: Column, z: Column) -> Column:
    return x.between(*ACTIVE[0]) & y.between(*ACTIVE[1]) & z.between(*ACTIVE[2])


def tick_to_x(tick: Column) -> Column:
    return (tick - TICK_OFFSET) * F.lit(TICK_CM)


def category_name(index: Column) -> Column:
    return F.get(F.array(*map(F.lit, CATEGORIES)), index)


def barycentre(x: Column, w: Column) -> Column:
    """Aggregate: the weighted mean."""
    return F.try_divide(F.sum(x * w), F.sum(w))


def width(x: Column, w: Column) -> Column:
    """Aggregate: sqrt(sum(w x^2) sum(w) - sum(w x)^2) / sum(w)."""
    s = F.sum(w * x * x) * F.sum(w) - F.pow(F.sum(w * x), 2)
    return F.try_divide(F.sqrt(F.greatest(s, F.lit(0.0))), F.sum(w))
