"""An extension: tile charges over a stream of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pixels as P


def tile_charges(hits: DataFrame, size: tuple[int, int] = (18, 16), window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, tile_index, charge, n_hits by event time; hits: ts, wire, t, adc. Rows later than `late` are left out by the watermark."""
    index = P.tile_index(F.col("wire"), F.col("t"), *size).alias("tile_index")
    return hits.withWatermark("ts", late).groupBy(F.window("ts", window), index).agg(F.sum("adc").alias("charge"), F.count("*").alias("n_hits"))


def score_rates(events: DataFrame, window: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes", threshold: float = 3.0) -> DataFrame:
    """window, kind, n, n_over, mean: scores by event time in sliding windows; events: ts, kind, score."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "kind")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("score") > threshold).alias("n_over"), F.avg("score").alias("mean"))
