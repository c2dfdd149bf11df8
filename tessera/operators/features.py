"""Shape and charge features of clusters, from their sparse pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def geometry(pixels: DataFrame, key: str = "row", threshold: float = 0, saturation: float = 100, top_share: float = 0.10, linear: float = 0.90) -> DataFrame:
    """Features by key; pixels: key, wire, t, adc, frame_area. Only adc > threshold counts; keys without such pixels give no row
    (empty() fills them in). Moments are about the weighted mean, in a second pass over the pixels.
    """
    lit = pixels.filter(F.col("adc") > threshold)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("adc"), "wire", "t"))
    first = lit.groupBy(key).agg(F.count("*").alias("n_points"), F.sum("adc").alias("q"), F.sum(F.col("adc") * F.col("wire")).alias("qw"), F.sum(F.col("adc") * F.col("t")).alias("qt"))
    means = first.select(key, "n_points", F.col("q").alias("total_charge"), (F.col("qw") / F.col("q")).alias("mw"), (F.col("qt") / F.col("q")).alias("mt"))
    rows = lit.withColumn("rank", rank).join(means, key)
    dw, dt, share = F.col("wire") - F.col("mw"), F.col("t") - F.col("mt"), F.col("adc") / F.col("total_charge")
    n_top = F.greatest(F.lit(1), F.ceil(F.lit(top_share) * F.col("n_points")))
    made = rows.groupBy(key, "n_points", "total_charge", "mw", "mt").agg(
        (F.max("wire") - F.min("wire") + 1).alias("bbox_w"),
        (F.max("t") - F.min("t") + 1).alias("bbox_h"),
        F.sum(share * dw * dw).alias("sww"), F.sum(share * dt * dt).alias("stt"), F.sum(share * dw * dt).alias("swt"),
        F.sum(F.when(F.col("rank") <= n_top, F.col("adc")).otherwise(0.0)).alias("top"),
        F.max("adc").alias("charge_max"), F.stddev_pop("adc").alias("charge_std"),
        F.count_if(F.col("adc") >= saturation).alias("n_saturated"),
        F.max("frame_area").alias("frame_area"),
    )
    half, spread = (F.col("sww") + F.col("stt")) / 2, F.sqrt(F.pow((F.col("sww") - F.col("stt")) / 2, 2) + F.col("swt") * F.col("swt"))
    made = made.withColumns({"l1": F.greatest(F.lit(0.0), half + spread), "l2": F.greatest(F.lit(0.0), half - spread), "bbox_area": F.col("bbox_w") * F.col("bbox_h")})
    trace = F.col("l1") + F.col("l2")
    angle = F.degrees(F.atan2(F.col("swt"), F.col("l1") - F.col("stt")))
    angle = F.when(angle >= 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)
    linearity = F.when(trace > 0, F.col("l1") / trace).otherwise(1.0)
    return made.select(
        key, "n_points", "total_charge", "bbox_w", "bbox_h", "bbox_area",
        (F.col("bbox_w") / F.col("bbox_h")).alias("aspect_ratio"),
        linearity.alias("linearity"),
        F.when(linearity >= linear, 1).otherwise(2).alias("n_pca_90"),
        (F.col("top") / F.col("total_charge")).alias("charge_conc"),
        (F.col("n_points") / F.col("bbox_area")).alias("hit_density"),
        F.try_divide(F.col("n_points"), F.col("frame_area")).alias("fill_frac"),
        (F.col("total_charge") / F.col("n_points")).alias("charge_mean"), "charge_max", "charge_std", "n_saturated",
        F.sqrt("l1").alias("pca_len1"), F.sqrt("l2").alias("pca_len2"),
        F.when(trace > 0, angle).alias("pca_angle_deg"),
        F.col("mw").alias("centroid_wire"), F.col("mt").alias("centroid_time"),
    )


def with_empty(features: DataFrame, clusters: DataFrame, key: str = "row") -> DataFrame:
    """A row for every cluster: without lit pixels counts and charge are 0, shapes null."""
    return clusters.select(key).join(features, key, "left").na.fill(0, ["n_points", "total_charge", "n_pca_90", "n_saturated"])
