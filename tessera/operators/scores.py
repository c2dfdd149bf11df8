"""Reconstruction scores and what is read off them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import quantile_values, quantiles


def total(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda s, v: s + v)


def mse(px: Column, rec: Column) -> Column:
    """Mean squared difference; null for empty images."""
    return F.try_divide(F.aggregate(F.zip_with(px, rec, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v), F.size(px))


def mean_image(df: DataFrame, px: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, pos, mean: by element, partial sums before the shuffle."""
    return df.select(*by, F.posexplode(px).alias("pos", "v")).groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def spread(df: DataFrame, px: str) -> DataFrame:
    """One row: the mean over elements of their standard deviation over rows, and the root mean square distance to the mean."""
    each = df.select(F.posexplode(px).alias("pos", "v")).groupBy("pos").agg(F.stddev_pop(F.col("v").cast("double")).alias("s"))
    return each.agg(F.avg("s").alias("mean_std"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("rms_distance"))


def percentiles(df: DataFrame, score: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """share, value; exact, with linear interpolation."""
    return quantiles(df, score, shares)


def charge_normalised(df: DataFrame, raw: str = "raw", inten: str = "inten", bins: int = 40, least: int = 20) -> DataFrame:
    """df with norm: raw over the score that is usual at its charge.

    Logarithms of both; bins between the distinct quantiles of log charge; medians of bins with `least` rows or more are
    knots; linear interpolation between them, flat outside. Rows without a positive raw and inten have null. The
    edges and knots, bins + 1 at most, are collected; the input is read for each of them, and for the result.
    """
    usable = (F.col(raw) > 0) & (F.col(inten) > 0)
    logs = df.filter(usable).select(F.log10(inten).alias("li"), F.log10(raw).alias("lr"))
    edges = sorted({q for q in quantile_values(logs, "li", tuple(k / bins for k in range(bins + 1))) if q is not None})
    if len(edges) < 2:
        return df.withColumn("norm", F.lit(None).cast("double"))
    place = F.lit(0)
    for k, e in enumerate(edges[1:-1], 1):
        place = F.when(F.col("li") >= F.lit(e), k).otherwise(place)
    both = logs.select(place.alias("b"), F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("li").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("lr").alias("v")))).alias("p")).select("b", "p.axis", "p.v")
    middle = {(r["b"], r["axis"]): (r["value"], r["n"]) for r in quantiles(both, "v", (0.5,), ("b", "axis"), counted=True).collect()}
    knots = sorted((x, middle[b, "y"][0]) for (b, axis), (x, n) in middle.items() if axis == "x" and n >= least)
    if not knots:
        return df.withColumn("norm", F.lit(None).cast("double"))
    x = F.log10(inten)
    usual = F.lit(knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        usual = F.when(x >= x0, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(usual) if x1 > x0 else usual
    usual = F.when(x >= knots[-1][0], F.lit(knots[-1][1])).otherwise(usual)
    return df.withColumn("norm", F.when(usable, F.col(raw) / F.pow(F.lit(10.0), usual)))


def confusion(df: DataFrame, score: str, positive: Column, threshold: Column | float) -> DataFrame:
    """One row: tp, fp, tn, fn of score > threshold, and recall, fpr, precision, f1 (0 where undefined)."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col(score) > cut
    row = df.agg(*(F.count_if(c).alias(n) for n, c in (("tp", hit & positive), ("fp", hit & ~positive), ("tn", ~hit & ~positive), ("fn", ~hit & positive))))
    return with_ratios(row)


def with_ratios(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = df.withColumns({"recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def clean_threshold(df: DataFrame, score: str, positive: Column, share: float = 0.95) -> float | None:
    return quantile_values(df.filter(~positive), score, (share,))[0]


def threshold_sweep(df: DataFrame, score: str, positive: Column, shares: tuple[float, ...] = (0.95, 0.99, 0.995, 0.999)) -> DataFrame:
    """name, threshold and confusion() for the clean rows' percentiles, their maximum, and the middle of the gap to the
    positives. Thresholds that need a class which has no score are left out."""
    limits = df.agg(F.max(F.when(~positive, F.col(score))).alias("most"), F.min(F.when(positive, F.col(score))).alias("least")).first()
    named = [(f"p{s * 100:g}", v) for s, v in zip(shares, quantile_values(df.filter(~positive), score, shares), strict=True)]
    named += [("max_clean", limits["most"]), ("gap_midpoint", None if None in (limits["most"], limits["least"]) else (limits["most"] + limits["least"]) / 2)]
    named = [(n, v) for n, v in named if v is not None]
    if not named:
        return confusion(df.limit(0), score, positive, 0.0).limit(0).select(F.lit("").alias("name"), F.lit(0.0).alias("threshold"), "*")
    at = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("threshold")) for n, v in named)))
    rows = df.select(F.col(score).alias("s"), positive.alias("p")).groupBy("s", "p").agg(F.count("*").alias("n")).withColumn("z", at)
    hit = F.col("s") > F.col("z.threshold")
    counts = rows.groupBy("z.name", "z.threshold").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("tp", hit & F.col("p")), ("fp", hit & ~F.col("p")), ("tn", ~hit & ~F.col("p")), ("fn", ~hit & F.col("p")))))
    return with_ratios(counts)


def separability(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: max_clean, min_anomalous, gap, and how many clean rows reach the least anomalous one."""
    edge = df.agg(F.max(F.when(~positive, F.col(score))).alias("max_clean"), F.min(F.when(positive, F.col(score))).alias("min_anomalous")).first()
    least = F.lit(edge["min_anomalous"]).cast("double")
    return df.agg(F.max(F.when(~positive, F.col(score))).alias("max_clean"), F.min(F.when(positive, F.col(score))).alias("min_anomalous"), F.count_if(~positive & (F.col(score) >= least)).alias("n_overlap")).withColumn("gap", F.col("min_anomalous") - F.col("max_clean"))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """epoch, loss: the mean of batch means; batches: epoch, batch, loss by sample."""
    return batches.groupBy("epoch", "batch").agg(F.avg("loss").alias("m")).groupBy("epoch").agg(F.avg("m").alias("loss"))


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch of least val_loss, the earliest of equal ones."""
    return history.agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("epoch"), F.min("val_loss").alias("val_loss"))


def class_medians(df: DataFrame, value: str, by: str, base: object) -> DataFrame:
    """by, median, ratio to the median of class `base`."""
    rows = quantiles(df, value, (0.5,), (by,)).select(by, F.col("value").alias("median"))
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a class
    return rows.withColumn("ratio", F.try_divide(F.col("median"), F.max(F.when(F.col(by) == base, F.col("median"))).over(every)))


def medians(df: DataFrame, columns: Iterable[str], by: str) -> DataFrame:
    """by and the median of each column by group, one row a group; null where a column has no value there."""
    columns = list(columns)
    long = df.select(by, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select(by, "x.name", "x.v")
    return quantiles(long, "v", (0.5,), (by, "name")).groupBy(by).pivot("name", columns).agg(F.first("value"))


def above_floor(df: DataFrame, floor: float = 0.0, raw: str = "raw", inten: str = "inten") -> DataFrame:
    """Rows that logarithms and ratios of scores can use: raw over the floor, and both positive."""
    return df.filter((F.col(raw) > floor) & (F.col(raw) > 0) & (F.col(inten) > 0))


def pool(df: DataFrame, name: str = "any") -> DataFrame:
    """Rows of a named pool: any, neutrino (percent_nu over 50) or cropped (was_cropped)."""
    pools = {"any": "true", "neutrino": "percent_nu > 50", "cropped": "cast(was_cropped as int) = 1"}
    if name not in pools:
        raise ValueError(f"one of {', '.join(pools)}, not {name}")
    return df.filter(pools[name])


def cut_purity(df: DataFrame, by: str, passes: Column) -> DataFrame:
    """selection (all, cut), by, n, share within the selection."""
    each = F.explode(F.when(passes, F.array(F.lit("all"), F.lit("cut"))).otherwise(F.array(F.lit("all"))))
    rows = df.withColumn("selection", each).groupBy("selection", by).agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("selection")))


def max_difference(df: DataFrame, a: str, b: str, relative: bool = False) -> DataFrame:
    diff = F.abs(F.col(a) - F.col(b))
    return df.agg(F.max(diff / F.greatest(F.col(b), F.lit(1e-9)) if relative else diff).alias("max_diff"))
