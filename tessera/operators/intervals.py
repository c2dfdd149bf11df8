"""Joins of intervals that overlap."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An interval lies in about this many buckets at most: buckets are never narrower than the range of all over this.
MOST = 1 << 16


def bucket_width(rows: DataFrame, low: str, high: str) -> float:
    """The mean length of the intervals, or more where their range is long; 1 if all are points at one place."""
    mean, least, most = rows.agg(F.avg(F.col(high) - F.col(low)), F.min(low), F.max(high)).first()
    if mean is None:
        return 1.0
    return max(float(mean), (float(most) - float(least)) / MOST) or 1.0


def overlapping(a: DataFrame, b: DataFrame, low: tuple[str, str], high: tuple[str, str], on: Iterable[str] = (), closed: bool = True, where: Column | None = None, width: float | None = None) -> DataFrame:
    """Pairs of a row of a and one of b whose intervals overlap, each once; low, high: the columns of a's and b's ends.

    Intervals are dealt to buckets of `width` and meet in the first one that both touch: an equality join, and the exact condition for
    what shares a bucket. closed: touching ends count. on: columns that must be equal (of both; kept once). where: what else a
    pair must fulfil. Columns of a and b must have different names but for `on`. Intervals with a null end, or whose high end is
    under the low one, overlap nothing. Infinite ends aren't allowed.
    """
    on = list(on)
    whole = lambda df, lo, hi: df.filter(F.col(lo) <= F.col(hi))
    a, b = whole(a, low[0], high[0]), whole(b, low[1], high[1])
    if width is None:
        width = bucket_width(a.select(F.col(low[0]).alias("l"), F.col(high[0]).alias("h")).union(b.select(low[1], high[1])), "l", "h")

    def dealt(df: DataFrame, lo: str, hi: str, first: str) -> DataFrame:
        bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(width))
        return df.withColumn(first, bucket(lo)).withColumn("_bucket", F.explode(F.sequence(F.col(first), bucket(hi))))

    pairs = dealt(a, low[0], high[0], "_first_a").join(dealt(b, low[1], high[1], "_first_b"), ["_bucket", *on])
    under = (lambda x, y: x <= y) if closed else (lambda x, y: x < y)
    meet = (F.col("_bucket") == F.greatest("_first_a", "_first_b")) & under(F.col(low[0]), F.col(high[1])) & under(F.col(low[1]), F.col(high[0]))
    return pairs.filter(meet if where is None else meet & where).drop("_bucket", "_first_a", "_first_b")
