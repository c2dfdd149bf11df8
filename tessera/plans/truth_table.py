"""The table of all clusters of one variant: identity, location, frame, features, hits, event and vertex columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.operators import clusters as C
from tessera.operators import features, frames
from tessera.operators import truth as H

#: The names and the order of the columns.
COLUMNS = [
    "row", "cluster_id", "source_file_id", "source_event_index", "n_tiles",
    "bbox_wire_lo", "bbox_wire_hi", "bbox_time_lo", "bbox_time_hi", "tile_row_lo", "tile_row_hi", "tile_col_lo", "tile_col_hi",
    "crop_w", "crop_h", "frame_w", "frame_h", "was_cropped", "frac_area_kept", "frac_charge_kept",
    "n_points", "total_charge", "bbox_area", "aspect_ratio", "linearity", "n_pca_90", "charge_conc", "hit_density", "percent_nu",
    "bbox_w", "bbox_h", "fill_frac", "charge_mean", "charge_max", "charge_std", "n_saturated", "pca_len1", "pca_len2", "pca_angle_deg", "centroid_wire", "centroid_time",
    "percent_nu_hits", "n_hits", "hit_charge", "nu_charge", "n_hits_cosmic", "n_hits_other", "n_hits_muon", "n_hits_pion", "n_hits_proton", "dominant_class", "is_nu_tile",
    "nu_pdg", "nu_energy_gev", "is_cc", "nu_vtx_wire", "nu_vtx_time", "vtx_in_frame", "vtx_dwire", "vtx_dtime", "vtx_dist",
]


def truth_table(clusters: DataFrame, pixels: DataFrame, hits: DataFrame, events: DataFrame, targets: DataFrame | None = None, size: tuple[int, int] = (18, 16), event: Iterable[str] = ("event_id",)) -> DataFrame:
    """COLUMNS for each cluster. clusters: from boxes(), with row; pixels: cut, not 0; hits: charge, share, class; events: the
    neutrino columns; targets: one row of frame_w and frame_h, none for the crops as they are.

    Features and truth are of what the frame keeps; both follow from the raw pixels and hits inside a window. Events are told
    by `event`, file_id and event_id where several files are read together; row must be unique over all.
    """
    event = list(event)
    if targets is None:
        sized = clusters.withColumns({"frame_w": F.col("crop_w"), "frame_h": F.col("crop_h")})
    else:
        sized = clusters.join(F.broadcast(targets.select("frame_w", "frame_h")), F.col("row").isNotNull())  # one row
    win = frames.window(sized)
    box = win.select("row", *event, "wire_lo", "wire_hi", "time_lo", "time_hi", "win_w_lo", "win_w_hi", "win_h_lo", "win_h_hi", "pad_w", "pad_h", "frame_w", "frame_h")
    points = C.inside(box, pixels, size, event)
    seen = frames.framed(points).withColumn("frame_area", F.col("frame_w") * F.col("frame_h"))
    shapes = features.with_empty(features.geometry(seen), clusters)
    charges = points.groupBy("row").agg(F.sum("adc").alias("all_charge")).join(seen.groupBy("row").agg(F.sum("adc").alias("kept_charge")), "row", "left")
    kept = frames.kept_shares(win, charges.select("row", F.col("all_charge").alias("total_charge"), F.coalesce("kept_charge", F.lit(0.0)).alias("kept_charge")))
    members = frames.framed(C.inside(box, hits, size, event))
    found = H.cluster_truth(members, clusters, hits, event=event)
    lit = hits.filter(F.col("class") != 0).select(*event, "wire", "t")
    nu_tiles = C.inside(clusters.select("row", *event, "wire_lo", "wire_hi", "time_lo", "time_hi"), lit, size, event).groupBy("row").agg(F.lit(1).alias("is_nu_tile"))
    whole = win.join(shapes, "row").join(kept, "row").join(found, "row").join(nu_tiles, "row", "left")
    whole = whole.withColumn("is_nu_tile", F.coalesce("is_nu_tile", F.lit(0)))
    x, y = F.col("nu_vtx_wire") - F.col("wire_lo"), F.col("nu_vtx_time") - F.col("time_lo")
    inside = (x >= F.col("win_w_lo")) & (x < F.col("win_w_hi")) & (y >= F.col("win_h_lo")) & (y < F.col("win_h_hi"))
    dw, dt = F.col("centroid_wire") - F.col("nu_vtx_wire"), F.col("centroid_time") - F.col("nu_vtx_time")
    out = whole.join(events, event, "left").withColumns({"vtx_dwire": dw, "vtx_dtime": dt, "vtx_dist": P.vertex_distance(dw, dt), "vtx_in_frame": F.when(F.col("n_hits") < 0, -1).otherwise(F.coalesce(inside.cast("int"), F.lit(-1)))})
    names = {"source_event_index": "event_id", "bbox_wire_lo": "wire_lo", "bbox_wire_hi": "wire_hi", "bbox_time_lo": "time_lo", "bbox_time_hi": "time_hi", "tile_row_lo": "row_lo", "tile_row_hi": "row_hi", "tile_col_lo": "col_lo", "tile_col_hi": "col_hi"}
    out = out.withColumn("source_file_id", F.col("file_id") if "file_id" in event else F.lit(0))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in COLUMNS))


def hit_tally(clusters: DataFrame, hits: DataFrame, size: tuple[int, int] = (18, 16), event: Iterable[str] = ("event_id",)) -> DataFrame:
    """row, class, n_hits, charge of the hits in each cluster's box; classes without a hit give no row."""
    event = list(event)
    members = C.inside(clusters.select("row", *event, "wire_lo", "wire_hi", "time_lo", "time_hi"), hits.select(*event, "wire", "t", "class", "charge"), size, event)
    return members.groupBy("row", "class").agg(F.count("*").alias("n_hits"), F.sum("charge").alias("charge"))
