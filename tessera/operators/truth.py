"""Truth of hits and clusters. Hits carry a key; deposits name the hit, a particle, and an ordinal for ties."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import pixels as P


def hit_shares(hits: DataFrame, deposits: DataFrame, keys: Iterable[str]) -> DataFrame:
    """hits with share: the summed energy fractions, between 0 and 1; 0 without a deposit."""
    keys = list(keys)
    total = deposits.groupBy(*keys).agg(F.sum("energy_fraction").alias("share"))
    return hits.join(total, keys, "left").withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0)))))


def dominant(deposits: DataFrame, keys: Iterable[str]) -> DataFrame:
    """keys, g4_id of the largest single fraction; of equal ones, the first by edep_row."""
    order = Window.partitionBy(*keys).orderBy(F.desc("energy_fraction"), "edep_row")
    return deposits.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*keys, "g4_id")


def unique(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """rows, with an error if a key occurs twice."""
    keys = list(keys)
    others = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in others))
    twice = F.raise_error(F.concat(F.lit("more than one row of "), F.to_json(F.struct(*keys))))
    return found.withColumn("_n", F.when(F.col("_n") > 1, twice.cast("long")).otherwise(F.col("_n"))).filter("_n = 1").select(*rows.columns)


def hit_classes(hits: DataFrame, deposits: DataFrame, particles: DataFrame, keys: Iterable[str], event: Iterable[str] = ("event_id",)) -> DataFrame:
    """hits with class: 0 (cosmic) without a deposit, else that of the dominant particle, other if it has no entry.

    Particle ids are unique within an event only: particles have the event's columns (file and event, where there are
    several files), g4_id and g4_pdg, each once.
    """
    keys, event = list(keys), list(event)
    found = hits.join(dominant(deposits, keys), keys, "left").join(unique(particles.select(*event, "g4_id", "g4_pdg"), [*event, "g4_id"]), [*event, "g4_id"], "left")
    return found.withColumn("class", F.when(F.col("g4_id").isNull(), 0).otherwise(F.coalesce(P.pdg_class(F.col("g4_pdg")), F.lit(1))))


def in_box(clusters: DataFrame, hits: DataFrame, keys: Iterable[str] = ("event_id",)) -> Column:
    """Event and half-open box: an equality key with a range as the rest of the condition."""
    same = [clusters[k] == hits[k] for k in keys]
    box = (hits.wire >= clusters.wire_lo) & (hits.wire < clusters.wire_hi) & (hits.t >= clusters.time_lo) & (hits.t < clusters.time_hi)
    for s in same:
        box = s & box
    return box


def cluster_truth(members: DataFrame, clusters: DataFrame, hit_events: DataFrame, key: str = "row", event: Iterable[str] = ("event_id",)) -> DataFrame:
    """Truth by cluster; members: key, charge, share, class of the hits inside.

    Three states: an event that has no hit at all gives n_hits -1 and class -1; a cluster without hits 0 and class -1, its
    percentages null; else the figures. Of classes with equally many hits, the lowest id is dominant.
    """
    names = P.HIT_CLASSES
    found = members.groupBy(key).agg(
        F.count("*").alias("n"), F.sum("charge").alias("hit_charge"), F.sum(F.col("charge") * F.col("share")).alias("nu_charge"),
        *(F.count_if(F.col("class") == k).alias(f"n_hits_{c}") for k, c in enumerate(names)),
    )
    counts = [F.col(f"n_hits_{c}") for c in names]
    most, best = F.greatest(*counts), F.lit(None).cast("int")
    for k in range(len(names) - 1, -1, -1):
        best = F.when(counts[k] == most, k).otherwise(best)
    event = list(event)
    known = hit_events.select(*event).distinct().withColumn("_known", F.lit(True))
    rows = clusters.select(key, *event).join(known, event, "left").join(found, key, "left")
    n = F.when(F.col("_known").isNull(), -1).otherwise(F.coalesce("n", F.lit(0)))
    return rows.select(
        key,
        n.alias("n_hits"),
        F.coalesce("hit_charge", F.lit(0)).alias("hit_charge"),
        F.coalesce("nu_charge", F.lit(0.0)).alias("nu_charge"),
        F.when(F.col("hit_charge") > 0, 100 * F.col("nu_charge") / F.col("hit_charge")).alias("percent_nu"),
        F.when(F.col("n") > 0, 100.0 * (F.col("n") - F.col("n_hits_cosmic")) / F.col("n")).alias("percent_nu_hits"),
        *(F.coalesce(f"n_hits_{c}", F.lit(0)).alias(f"n_hits_{c}") for c in names),
        F.when(F.col("n") > 0, best).otherwise(-1).alias("dominant_class"),
    )


def tracks_per_tile(hits: DataFrame, deposits: DataFrame, keys: Iterable[str], size: tuple[int, int] = (18, 16), least: int = 5, event: Iterable[str] = ("event_id",)) -> DataFrame:
    """event, tile_index, n_tracks: particles that dominate `least` hits or more of the tile."""
    keys, event = list(keys), list(event)
    rows = hits.join(dominant(deposits, keys), keys).groupBy(*event, P.tile_index(F.col("wire"), F.col("t"), *size).alias("tile_index"), "g4_id").agg(F.count("*").alias("n"))
    return rows.filter(F.col("n") >= least).groupBy(*event, "tile_index").agg(F.count("*").alias("n_tracks"))


def vertices(clusters: DataFrame, events: DataFrame, hit_events: DataFrame, event: Iterable[str] = ("event_id",)) -> DataFrame:
    """clusters with the event's neutrino columns (null where it is missing), offsets of the centroid, and whether the
    vertex lies in the frame: -1 if it is unknown, or if the event has no hit on the plane (no row in hit_events)."""
    event = list(event)
    known = hit_events.select(*event).distinct().withColumn("_known", F.lit(True))
    rows = clusters.join(events, event, "left").join(known, event, "left")
    dw, dt = F.col("centroid_wire") - F.col("nu_vtx_wire"), F.col("centroid_time") - F.col("nu_vtx_time")
    inside = (F.col("nu_vtx_wire") >= F.col("wire_lo")) & (F.col("nu_vtx_wire") < F.col("wire_hi")) & (F.col("nu_vtx_time") >= F.col("time_lo")) & (F.col("nu_vtx_time") < F.col("time_hi"))
    state = F.when(F.col("_known").isNull(), -1).otherwise(F.coalesce(inside.cast("int"), F.lit(-1)))
    return rows.withColumns({"vtx_dwire": dw, "vtx_dtime": dt, "vtx_dist": P.vertex_distance(dw, dt), "vtx_in_frame": state}).drop("_known")
