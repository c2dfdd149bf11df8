"""Fixed frames for clusters: target sizes, centre crop and pad, and downscaling by exact area averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import quantiles


def even_ceil(v: Column) -> Column:
    c = F.ceil(v)
    return (c + c % 2).cast("long")


def pad_targets(clusters: DataFrame, percents: tuple[float, ...] = (50, 75)) -> DataFrame:
    """pct, frame_w, frame_h: the smallest even sizes at or over the percentile of crop_w and crop_h."""
    share = F.array(*(F.lit(p / 100) for p in percents))
    row = clusters.agg(F.percentile("crop_w", share).alias("w"), F.percentile("crop_h", share).alias("h"))
    rows = row.withColumn("pct", F.array(*(F.lit(int(p)) for p in percents))).select(F.explode(F.arrays_zip("pct", "w", "h")).alias("z"))
    return rows.select("z.pct", even_ceil(F.col("z.w")).alias("frame_w"), even_ceil(F.col("z.h")).alias("frame_h"))


def window(clusters: DataFrame) -> DataFrame:
    """With crop_w, crop_h, frame_w, frame_h: what survives a centre crop (win_*, within the crop, half open), where it
    lies in the frame (pad_*), and was_cropped."""
    out = clusters
    for side in ("w", "h"):
        crop, frame = F.col(f"crop_{side}"), F.col(f"frame_{side}")
        cut = F.floor(F.greatest(crop - frame, F.lit(0)) / 2).cast("long")
        out = out.withColumns({f"win_{side}_lo": cut, f"win_{side}_hi": cut + F.least(crop, frame), f"pad_{side}": F.floor(F.greatest(frame - crop, F.lit(0)) / 2).cast("long")})
    return out.withColumn("was_cropped", (F.col("crop_w") > F.col("frame_w")) | (F.col("crop_h") > F.col("frame_h")))


def framed(points: DataFrame) -> DataFrame:
    """Pixels of clusters with window()'s columns: those that survive, with their place in the frame (frame_x, frame_y)."""
    x, y = F.col("wire") - F.col("wire_lo"), F.col("t") - F.col("time_lo")
    kept = (x >= F.col("win_w_lo")) & (x < F.col("win_w_hi")) & (y >= F.col("win_h_lo")) & (y < F.col("win_h_hi"))
    return points.filter(kept).withColumns({"frame_x": x - F.col("win_w_lo") + F.col("pad_w"), "frame_y": y - F.col("win_h_lo") + F.col("pad_h")})


def kept_shares(clusters: DataFrame, charges: DataFrame, key: str = "row") -> DataFrame:
    """key, frac_area_kept, frac_charge_kept; charges: key, total_charge, kept_charge. 1 if not cropped; null charge share if there is no charge."""
    area = F.try_divide((F.col("win_w_hi") - F.col("win_w_lo")) * (F.col("win_h_hi") - F.col("win_h_lo")), F.col("crop_w") * F.col("crop_h"))
    charge = F.when(~F.col("was_cropped"), F.lit(1.0)).when(F.col("total_charge") > 0, F.col("kept_charge") / F.col("total_charge"))
    return clusters.join(charges, key, "left").select(key, F.when(~F.col("was_cropped"), F.lit(1.0)).otherwise(area).alias("frac_area_kept"), charge.alias("frac_charge_kept"))


def fit_share(clusters: DataFrame, w: int, h: int) -> DataFrame:
    return clusters.agg(F.avg(((F.col("crop_w") <= w) & (F.col("crop_h") <= h)).cast("double")).alias("fit_fraction"))


def with_scale(clusters: DataFrame) -> DataFrame:
    """downscale_factor (1 at most), and the scaled sizes new_w, new_h: halves go to the even number, between 1 and the frame."""
    scale = F.least(F.lit(1.0), F.col("frame_w") / F.col("crop_w"), F.col("frame_h") / F.col("crop_h"))
    out = clusters.withColumn("downscale_factor", scale)
    size = lambda s: F.greatest(F.lit(1), F.least(F.col(f"frame_{s}"), F.bround(F.col(f"crop_{s}") * F.col("downscale_factor")).cast("long")))
    return out.withColumns({"new_w": size("w"), "new_h": size("h"), "was_downscaled": F.col("downscale_factor") < 1})


def resize(points: DataFrame, key: str = "row") -> DataFrame:
    """Area averages: key, x, y, value of the cells that pixels touch; points: key, px, py, v, crop_w, crop_h, new_w, new_h.

    A cell's value is the integral of the image over it, divided by its area: each pixel adds its value times its
    overlap with the cell. A pixel meets few cells, and partial sums are made before the shuffle.
    """

    def cells(place: str, old: str, new: str) -> Column:
        step = F.col(old) / F.col(new)
        lo = F.floor(F.col(place) / step + F.lit(1e-12))
        hi = F.least(F.col(new) - 1, F.ceil((F.col(place) + 1) / step - F.lit(1e-12)) - 1)
        overlap = lambda c: F.least(F.col(place) + 1, (c + 1) * step) - F.greatest(F.col(place).cast("double"), c * step)
        return F.transform(F.sequence(lo.cast("long"), hi.cast("long")), lambda c: F.struct(c.alias("c"), overlap(c).alias("o")))

    wide = points.withColumn("x", F.explode(cells("px", "crop_w", "new_w"))).withColumn("y", F.explode(cells("py", "crop_h", "new_h")))
    area = (F.col("crop_w") / F.col("new_w")) * (F.col("crop_h") / F.col("new_h"))
    return wide.groupBy(key, F.col("x.c").alias("x"), F.col("y.c").alias("y")).agg(F.sum(F.col("v") * F.col("x.o") * F.col("y.o") / area).alias("value"))


def crop_summary(windows: DataFrame, lit: DataFrame, by: str = "pct", key: str = "row") -> DataFrame:
    """by, n, n_cropped, cropped_percent, zero_fraction: windows: from window(), with by; lit: by, key, n_lit (pixels that
    aren't 0 in the frame). The zero fraction is the mean over frames of the share of their places without charge."""
    zero = 1 - F.coalesce("n_lit", F.lit(0)) / (F.col("frame_w") * F.col("frame_h"))
    rows = windows.join(lit, [by, key], "left")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("was_cropped").alias("n_cropped"), (100 * F.avg(F.col("was_cropped").cast("double"))).alias("cropped_percent"), F.avg(zero).alias("zero_fraction"))


def downscale_summary(scaled: DataFrame, by: str = "pct") -> DataFrame:
    """by, n, n_downscaled, downscaled_percent, and median and smallest factor of those (null if there are none); scaled:
    from with_scale(), with by."""
    small = F.col("was_downscaled")
    counted = scaled.groupBy(by).agg(F.count("*").alias("n"), F.count_if(small).alias("n_downscaled"), (100 * F.avg(small.cast("double"))).alias("downscaled_percent"), F.min(F.when(small, F.col("downscale_factor"))).alias("min_factor"))
    middle = quantiles(scaled.filter(small), "downscale_factor", (0.5,), (by,)).select(by, F.col("value").alias("median_factor"))
    return counted.join(middle, by, "left")


def with_raw(scaled: DataFrame, raw: DataFrame, key: str = "row", index: str = "raw_index") -> DataFrame:
    """Rows of a table that was numbered anew, with the columns of the raw row that `index` names."""
    return scaled.join(raw.withColumnRenamed(key, index), index, "left")
