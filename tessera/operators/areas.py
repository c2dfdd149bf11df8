"""Summed-area tables of sparse images: the sum of any box from four lookups.

An image's table is kept by tiles. The sum of all pixels before wire w and tick t is made of what a tile carries: corner (all before its first
wire and tick), top (by tick offset: of its columns, what lies before its first wire), left (by wire offset: of its rows, what
lies before its first tick), and local (by both offsets: its own pixels). Tiles without a pixel have an empty local part.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pixels as P


def summed_areas(pixels: DataFrame, value: str = "adc", size: tuple[int, int] = (18, 16), keys: Iterable[str] = ("event_id",), shape: tuple[int, int] = (P.WIRES, P.TICKS)) -> DataFrame:
    """keys, tile_index, corner, top, left, local of every tile of every image that has a pixel. pixels: keys, wire, t and the value;
    rows of one pixel are added up, null values count as 0, and rows outside the image are an error.

    An image's group is its pixels, and two arrays of its shape.
    """
    keys, (sw, st), (w, h) = list(keys), size, shape
    if w % sw or h % st:
        raise ValueError("tiles must fill the image")
    rows, columns = w // sw, h // st
    table = pixels.select(*keys, F.col("wire").cast("long").alias("wire"), F.col("t").cast("long").alias("t"), F.col(value).cast("double").alias("v"))
    schema = table.select(*keys).withColumns({"tile_index": F.lit(0).cast("long"), "corner": F.lit(0.0)} | {c: F.array().cast("array<double>") for c in ("top", "left", "local")}).schema

    def summed(part: pa.Table) -> pa.Table:
        image = np.zeros((w + 1, h + 1))
        wire, t = part.column("wire").to_numpy(), part.column("t").to_numpy()
        if len(wire) and not (0 <= wire.min() and wire.max() < w and 0 <= t.min() and t.max() < h):
            raise ValueError(f"a pixel outside {w} x {h}")
        np.add.at(image, (wire + 1, t + 1), part.column("v").fill_null(0.0).to_numpy())
        lit = np.zeros((rows, columns), bool)
        lit[wire // sw, t // st] = True
        before = image.cumsum(axis=0).cumsum(axis=1)
        corner = before[:-1:sw, :-1:st]
        across = np.arange(columns)[:, None] * st + np.arange(st + 1)
        down = np.arange(rows)[:, None] * sw + np.arange(sw + 1)
        top = before[:-1:sw][:, across] - corner[:, :, None]  # row, column, tick offset
        left = before[:, :-1:st][down].transpose(0, 2, 1) - corner[:, :, None]  # row, column, wire offset
        local = [[]] * (rows * columns)
        for r, c in zip(*np.nonzero(lit), strict=True):
            own = before[r * sw : (r + 1) * sw + 1, c * st : (c + 1) * st + 1]
            local[r * columns + c] = (own - corner[r, c] - top[r, c] - left[r, c][:, None]).ravel()
        n = rows * columns
        held = [pa.array([part.column(k)[0].as_py()] * n, part.schema.field(k).type) for k in keys]
        fixed = lambda a, m: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), m).cast(pa.list_(pa.float64()))
        columns_ = [*held, pa.array(np.arange(n)), pa.array(corner.ravel()), fixed(top, st + 1), fixed(left, sw + 1), pa.array(local, pa.list_(pa.float64()))]
        return pa.table(columns_, [*keys, "tile_index", "corner", "top", "left", "local"])

    return table.groupBy(*keys).applyInArrow(summed, schema)


def box_sums(areas: DataFrame, boxes: DataFrame, key: str = "row", name: str = "total", size: tuple[int, int] = (18, 16), keys: Iterable[str] = ("event_id",), shape: tuple[int, int] = (P.WIRES, P.TICKS)) -> DataFrame:
    """key and the sum of each box (keys, key, wire_lo, wire_hi, time_lo, time_hi; half open, clipped to the image) by four lookups. 0
    for empty boxes and where the image has no pixel."""
    keys, (sw, st) = list(keys), size
    clip = lambda c, n: F.least(F.lit(n), F.greatest(F.lit(0), F.col(c))).cast("long")
    w = [clip("wire_lo", shape[0]), F.greatest(clip("wire_lo", shape[0]), clip("wire_hi", shape[0]))]
    t = [clip("time_lo", shape[1]), F.greatest(clip("time_lo", shape[1]), clip("time_hi", shape[1]))]
    corners = F.array(*(F.struct(w[i].alias("w"), t[j].alias("t"), F.lit(1.0 if i == j else -1.0).alias("sign")) for i in (0, 1) for j in (0, 1)))
    asked = boxes.select(*keys, key, F.explode(corners).alias("c"))
    # the image's far edges belong to the last tiles
    row, col = F.least(F.floor(F.col("c.w") / sw), F.lit(shape[0] // sw - 1)), F.least(F.floor(F.col("c.t") / st), F.lit(shape[1] // st - 1))
    asked = asked.select(*keys, key, "c.sign", (row * (shape[1] // st) + col).cast("long").alias("tile_index"), (F.col("c.w") - row * sw).cast("int").alias("_w"), (F.col("c.t") - col * st).cast("int").alias("_t"))
    local = F.coalesce(F.get("local", F.col("_w") * (st + 1) + F.col("_t")), F.lit(0.0))
    value = F.col("corner") + F.get("top", F.col("_t")) + F.get("left", F.col("_w")) + local
    return asked.join(areas, [*keys, "tile_index"], "left").groupBy(key).agg(F.coalesce(F.sum(F.col("sign") * value), F.lit(0.0)).alias(name))
