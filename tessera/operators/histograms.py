"""Binned counts. Bins are made by floor, so that a value on an edge goes to the upper bin; the last bin takes its upper edge."""

from __future__ import annotations

from math import log10, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import quantiles


def bin_of(v: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """0 .. bins-1; null outside low .. high."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))
    return F.when((v >= low) & (v <= high), b).cast("int")


def fixed(df: DataFrame, value: str, bins: int = 60, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, n; over the values' range by default."""
    if low is None or high is None:
        low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        return df.filter(F.col(value).isNotNull()).groupBy(F.lit(0).alias("bin")).agg(F.count("*").alias("n"))
    return df.select(bin_of(F.col(value), low, high, bins).alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("n"))


def log_by_class(df: DataFrame, value: str, by: str, low: float, high: float, edges: int = 60) -> DataFrame:
    """by, bin, n, weight: `edges` log-spaced edges make edges - 1 bins; weights add up to 1 in a class."""
    rows = df.filter(F.col(value) > 0).select(by, bin_of(F.log10(value), log10(low), log10(high), edges - 1).alias("bin")).dropna(subset=["bin"])
    return rows.groupBy(by, "bin").agg(F.count("*").alias("n")).withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def log_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: tuple[int, int] = (18, 30)) -> DataFrame:
    """bin_x, bin_y, n of the cells that have rows."""
    rows = df.filter((F.col(x) > 0) & (F.col(y) > 0)).select(bin_of(F.log10(x), log10(x_range[0]), log10(x_range[1]), bins[0]).alias("bin_x"), bin_of(F.log10(y), log10(y_range[0]), log10(y_range[1]), bins[1]).alias("bin_y"))
    return rows.dropna().groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def efficiency(df: DataFrame, value: str, passes: Column, edges: list[float], absolute: bool = False, compat: bool = False) -> DataFrame:
    """bin, centre, n, n_pass, eff, err = sqrt(e (1 - e) / n); values on an edge count nowhere, empty bins give no row.

    absolute: bins of |value|. compat: with absolute, every row of the positive side counts as passed in the
    denominator's complement, as a missing parenthesis makes it: the acceptance binds to the negative side alone.
    """
    v = F.col(value)
    spans = F.array(*(F.struct(F.lit(k).alias("bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))
    rows = df.withColumn("_p", passes).withColumn("_b", F.explode(spans))
    up = (v > F.col("_b.lo")) & (v < F.col("_b.hi"))
    down = (v < -F.col("_b.lo")) & (v > -F.col("_b.hi"))
    total = up | down if absolute else up
    passed = (up | (down & F.col("_p"))) if absolute and compat else (total & F.col("_p"))
    made = rows.filter(total).groupBy("_b").agg(F.count("*").alias("n"), F.count_if(passed).alias("n_pass"))
    e = F.col("n_pass") / F.col("n")
    return made.select("_b.bin", ((F.col("_b.lo") + F.col("_b.hi")) / 2).alias("centre"), "n", "n_pass", e.alias("eff"), F.sqrt(e * (1 - e) / F.col("n")).alias("err"))


def integer(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def binned_quartiles(df: DataFrame, x: str, y: str, low: float, high: float, bins: int, passes: Column) -> DataFrame:
    """bin, n, q25, q50, q75 of y and the share that passes, by bin of log10 x."""
    rows = df.filter(F.col(x) > 0).withColumn("bin", bin_of(F.log10(x), low, high, bins)).filter(F.col("bin").isNotNull())
    counted = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(passes.cast("double")).alias("pass_share"))
    cuts = quantiles(rows, y, (0.25, 0.5, 0.75), ("bin",)).groupBy("bin").agg(*(F.max(F.when(F.col("share") == q, F.col("value"))).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)))
    return counted.join(cuts, "bin", "left").select("bin", "n", "q25", "q50", "q75", "pass_share")


def density(df: DataFrame, value: str, bins: int = 100, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin, centre, n, density of all bins of the range: the bars' areas add up to 1."""
    if low is None or high is None:
        low, high = df.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    if low is None:
        return fixed(df, value, bins, 0.0, 1.0).select("bin", F.lit(0.0).alias("centre"), "n", F.lit(0.0).alias("density"))
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    rows = every.join(fixed(df, value, bins, low, high), "bin", "left").na.fill(0, ["n"])  # a row for each bin
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return rows.select("bin", (low + (F.col("bin") + 0.5) * step).alias("centre"), "n", F.try_divide(F.col("n"), total * F.lit(step)).alias("density"))


def smooth_density(df: DataFrame, value: str, points: int = 100, grid: int = 2048) -> DataFrame:
    """x, density of a Gaussian kernel estimate at `points` places, by Scott's bandwidth: std * n^(-1/5).

    Values are counted in `grid` cells first; kernels stand at the cells' middles, so that the work after one pass is
    points x grid numbers, whatever the rows. Without two different values there are no rows.
    """
    n, s, low, high = df.filter(F.col(value).isNotNull()).agg(F.count("*"), F.stddev_samp(value), F.min(value).cast("double"), F.max(value).cast("double")).first()
    if not n or not s:
        return df.limit(0).select(F.lit(0.0).alias("x"), F.lit(0.0).alias("density"))
    width, step = s * n**-0.2, (high - low) / grid
    cells = fixed(df, value, grid, low, high).select((low + (F.col("bin") + 0.5) * step).alias("c"), F.col("n").alias("k"))
    ends = low - 3 * width, high + 3 * width
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(ends[0]) + i * ((ends[1] - ends[0]) / (points - 1)))
    rows = cells.withColumn("x", F.explode(places))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("c")) / width, F.lit(2.0)))
    return rows.groupBy("x").agg((F.sum(F.col("k") * kernel) / (n * width * (2 * pi) ** 0.5)).alias("density"))


def equal_weights(df: DataFrame, out: str = "weight") -> DataFrame:
    """df with 1 / number of rows."""
    return df.withColumn(out, F.lit(1.0 / max(df.count(), 1)))
