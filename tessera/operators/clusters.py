"""Clusters of kept tiles: connected over edges and corners, within an event."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.operators.graph import connected_components


def label_event(tiles: pd.DataFrame, columns: int) -> pd.Series:
    """The smallest tile_index of each tile's component, by union of 8-neighbours on one event's grid."""
    index = tiles["tile_index"].to_numpy()
    order = {v: k for k, v in enumerate(index.tolist())}
    parent = np.arange(len(index)).tolist()

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for v, k in order.items():
        r, c = divmod(v, columns)
        for near in ((r, c + 1), (r + 1, c - 1), (r + 1, c), (r + 1, c + 1)):
            if 0 <= near[1] < columns and (j := order.get(near[0] * columns + near[1])) is not None:
                a, b = top(k), top(j)
                if index[a] < index[b]:
                    parent[b] = a
                else:
                    parent[a] = b
    return pd.Series(index[[top(k) for k in range(len(index))]], index=tiles.index)


def label(tiles: DataFrame, st: int = 16, keys: Iterable[str] = ("event_id",), ticks: int = P.TICKS) -> DataFrame:
    """tiles with root (the component's smallest tile_index) and label: components of an event in the order of their roots, from 1.

    An event's grid is bounded (192 x 40 tiles at most), so one event is one group.
    """
    keys, columns = list(keys), ticks // st
    rows = tiles.select(*keys, "tile_index")
    schema = rows.withColumn("root", F.lit(0).cast("long")).schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("tile_index")
        return pdf.assign(root=label_event(pdf, columns))

    found = rows.groupBy(*keys).applyInPandas(one, schema)
    return found.withColumn("label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("root")).cast("long"))


def label_by_joins(tiles: DataFrame, st: int = 16, key: str = "event_id", ticks: int = P.TICKS) -> DataFrame:
    """label()'s root by joins and rounds of minima alone, for grids of any size. tiles: one key of type long."""
    columns = ticks // st
    rows = tiles.select(key, "tile_index").distinct()
    row, col = P.tile_row(F.col("tile_index"), st, ticks), P.tile_col(F.col("tile_index"), st, ticks)
    shifts = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))))
    wide = rows.withColumn("d", F.explode(shifts)).filter((col + F.col("d.c")).between(0, columns - 1))
    near = wide.select(key, "tile_index", ((row + F.col("d.r")) * columns + col + F.col("d.c")).alias("near"))
    size = F.lit(1 << 24).cast("long")
    edges = near.join(rows.select(key, F.col("tile_index").alias("near")), [key, "near"]).select((F.col(key) * size + F.col("tile_index")).alias("a"), (F.col(key) * size + F.col("near")).alias("b"))
    part = connected_components(edges)
    node = (F.col(key) * size + F.col("tile_index")).alias("node")
    joined = rows.select(key, "tile_index", node).join(part, "node", "left")
    return joined.select(key, "tile_index", F.coalesce(F.col("component") % size, F.col("tile_index")).alias("root"))


def summarise(labelled: DataFrame, st: int = 16, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """keys, cluster_id, n_tiles and the tile box, half open: row_lo, row_hi, col_lo, col_hi."""
    row, col = P.tile_row(F.col("tile_index"), st), P.tile_col(F.col("tile_index"), st)
    return labelled.groupBy(*keys, F.col("label").alias("cluster_id")).agg(
        F.count("*").alias("n_tiles"),
        F.min(row).alias("row_lo"), (F.max(row) + 1).alias("row_hi"),
        F.min(col).alias("col_lo"), (F.max(col) + 1).alias("col_hi"),
    )


def with_state(clusters: DataFrame, grid: tuple[int, int] = (192, 40), min_tiles: int = 3, max_tiles: int | None = 300, max_span: float | None = 0.6) -> DataFrame:
    """clusters with state: small (under min_tiles), giant (over either cap) or kept. A cap of None is off."""
    giant = F.lit(False)
    if max_tiles is not None:
        giant = giant | (F.col("n_tiles") > max_tiles)
    if max_span is not None:
        giant = giant | (F.col("row_hi") - F.col("row_lo") > F.lit(max_span * grid[0])) | (F.col("col_hi") - F.col("col_lo") > F.lit(max_span * grid[1]))
    return clusters.withColumn("state", F.when(F.col("n_tiles") < min_tiles, "small").when(giant, "giant").otherwise("kept"))


def per_event(clusters: DataFrame, events: DataFrame, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """keys, n_clusters of kept clusters; 0 for the events without one."""
    n = clusters.filter("state = 'kept'").groupBy(*keys).agg(F.count("*").alias("n_clusters"))
    return events.select(*keys).distinct().join(n, list(keys), "left").na.fill(0, ["n_clusters"])


def giants(clusters: DataFrame) -> DataFrame:
    return clusters.filter("state = 'giant'").agg(F.count("*").alias("n"), F.percentile("n_tiles", 0.5).alias("median_tiles"), F.max("n_tiles").alias("max_tiles"))


def run_summary(clusters: DataFrame, events: DataFrame, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """One row: events, clusters by state, and kept clusters by event (mean, median, most)."""
    states = ("kept", "small", "giant")
    n = clusters.groupBy(*keys).agg(*(F.count_if(F.col("state") == s).alias(s) for s in states))
    each = events.select(*keys).distinct().join(n, list(keys), "left").na.fill(0, list(states))
    return each.agg(
        F.count("*").alias("n_events"),
        F.avg("kept").alias("mean_per_event"), F.percentile("kept", 0.5).alias("median_per_event"), F.max("kept").alias("max_per_event"),
        *(F.sum(s).alias(f"n_{s}") for s in states),
    )


def boxes(clusters: DataFrame, size: tuple[int, int] = (18, 16), pad: int = 1, shape: tuple[int, int] = (P.WIRES, P.TICKS)) -> DataFrame:
    """clusters with the pixel box of the tile box and `pad` tiles around it, clipped to the image, half open, and its width and height."""
    sw, st = size
    edge = lambda c, step, n, most: F.least(F.lit(most), F.greatest(F.lit(0), (F.col(c) + n) * step)).cast("long")
    out = clusters.withColumns({"wire_lo": edge("row_lo", sw, -pad, shape[0]), "wire_hi": edge("row_hi", sw, pad, shape[0]), "time_lo": edge("col_lo", st, -pad, shape[1]), "time_hi": edge("col_hi", st, pad, shape[1])})
    return out.withColumns({"crop_w": F.col("wire_hi") - F.col("wire_lo"), "crop_h": F.col("time_hi") - F.col("time_lo")})


def touched(clusters: DataFrame, size: tuple[int, int] = (18, 16)) -> DataFrame:
    """clusters once for each tile that their pixel box touches, with its tile_index; none for empty boxes."""
    sw, st = size
    clusters = clusters.filter((F.col("wire_lo") < F.col("wire_hi")) & (F.col("time_lo") < F.col("time_hi")))
    r = F.sequence(F.floor(F.col("wire_lo") / sw), F.floor((F.col("wire_hi") - 1) / sw))
    c = F.sequence(F.floor(F.col("time_lo") / st), F.floor((F.col("time_hi") - 1) / st))
    tiles = clusters.withColumn("_r", F.explode(r)).withColumn("_c", F.explode(c))
    return tiles.withColumn("tile_index", (F.col("_r") * (P.TICKS // st) + F.col("_c")).cast("long")).drop("_r", "_c")


def within(tiles: DataFrame, points: DataFrame, size: tuple[int, int] = (18, 16), keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """inside() of the clusters that touched() gave these tiles."""
    rows = points.withColumn("tile_index", P.tile_index(F.col("wire"), F.col("t"), *size))
    box = (F.col("wire") >= F.col("wire_lo")) & (F.col("wire") < F.col("wire_hi")) & (F.col("t") >= F.col("time_lo")) & (F.col("t") < F.col("time_hi"))
    return tiles.join(rows, [*keys, "tile_index"]).filter(box).drop("tile_index")


def inside(clusters: DataFrame, points: DataFrame, size: tuple[int, int] = (18, 16), keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """Each cluster with the points (keys, wire, t, ...) in its pixel box; a point may lie in several.

    The range join is an equality join on the tiles that a box touches, and the range itself for what is left: boxes may lie
    off the tile grid, and each point is found once.
    """
    return within(touched(clusters, size), points, size, keys)
