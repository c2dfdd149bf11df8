"""Cases with known results."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import pixels as P
from tessera.operators import clusters, features, frames, graph, histograms, ranking, sampling, scores, tiles, truth


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def image(spark, pixels):
    return frame(spark, [(0, int(w), int(t), float(v)) for (w, t), v in pixels.items()], "event_id long, wire long, t long, adc double")


def shape(spark, pixels, **how):
    rows = image(spark, pixels).withColumnRenamed("event_id", "row").withColumn("frame_area", F.lit(1600.0))
    return features.geometry(rows, **how).first()


def test_cuts(spark):
    rows = frame(spark, [(-5.0,), (9.9,), (10.0,), (50.0,), (100.0,), (101.0,)], "v double")
    assert [r[0] for r in rows.select(P.apply_cuts(F.col("v"))).collect()] == [0, 0, 10, 50, 100, 100]
    twice = rows.select(P.apply_cuts(P.apply_cuts(F.col("v"))).alias("b"), P.apply_cuts(F.col("v")).alias("a"))
    assert all(r.a == r.b for r in twice.collect())


def grid(spark):
    on = [(r, c) for r in (2, 3, 4) for c in (2, 3)] + [(2, 6)] + [(8, c) for c in range(10)]
    return frame(spark, [(0, r * 10 + c) for r, c in on], "event_id long, tile_index long")


def test_cluster_map(spark):
    found = clusters.label(grid(spark), st=64)
    n = sorted(r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect())
    assert n == [1, 6, 10]
    made = clusters.with_state(clusters.summarise(found, st=64), grid=(20, 10))
    assert sorted((r["n_tiles"], r["state"]) for r in made.collect()) == [(1, "small"), (6, "kept"), (10, "giant")]


def test_labels_do_not_depend_on_row_order_or_method(spark):
    a = {r["tile_index"]: r["root"] for r in clusters.label(grid(spark).orderBy(F.desc("tile_index")), st=64).collect()}
    b = {r["tile_index"]: r["root"] for r in clusters.label_by_joins(grid(spark), st=64).collect()}
    assert a == b


def test_no_wrap_around(spark):
    rows = frame(spark, [(0, 9), (0, 10)], "event_id long, tile_index long")  # ends of neighbouring rows
    assert clusters.label(rows, st=64).select("root").distinct().count() == 2
    assert clusters.label_by_joins(rows, st=64).select("root").distinct().count() == 2


def test_box_of_a_cluster(spark):
    rows = frame(spark, [(0, 1, 6, 2, 5, 2, 4)], "event_id long, cluster_id long, n_tiles long, row_lo long, row_hi long, col_lo long, col_hi long")
    box = clusters.boxes(rows, shape=(360, 160)).first()
    assert (box["crop_w"], box["crop_h"]) == (90, 64)


def test_tiles_lose_nothing(spark):
    px = {(w, t): (w * 7 + t * 3) % 90 + 10 for w in range(0, 40, 3) for t in range(0, 40, 5)}
    rows = image(spark, px)
    for size in P.TILE_SIZES:
        assert tiles.catalog(rows, size).agg(F.sum("charge")).first()[0] == sum(px.values())
    back = tiles.restore(tiles.dense(rows, (18, 16)), (18, 16))
    assert {(r["wire"], r["t"]): r["adc"] for r in back.collect()} == px


def test_thresholds_up_to_the_cutoff_keep_the_same(spark):
    rows = tiles.catalog(tiles.cut(image(spark, {(0, 0): 3, (20, 0): 10, (40, 0): 60})), (18, 16))
    kept = {r["threshold"]: r["kept"] for r in tiles.threshold_scan(rows, (0.5, 5, 10, 50)).collect()}
    assert kept == {0.5: 2, 5: 2, 10: 2, 50: 1}
    assert tiles.keep(rows, 0).count() == 2


def test_line(spark):
    r = shape(spark, {(k, k): 50 for k in range(40)})
    assert (r["linearity"], r["n_pca_90"], r["bbox_w"], r["bbox_h"]) == (pytest.approx(1), 1, 40, 40)
    assert r["pca_angle_deg"] == pytest.approx(45) and r["hit_density"] == pytest.approx(40 / 1600)


def test_square(spark):
    r = shape(spark, {(a, b): 10 for a in range(20) for b in range(20)})
    assert (r["linearity"], r["n_pca_90"], r["charge_conc"], r["aspect_ratio"]) == (pytest.approx(0.5), 2, pytest.approx(0.1), 1)


def test_hot_pixel_single_and_empty(spark):
    r = shape(spark, {(k, 0): 10 for k in range(50)} | {(50, 0): 1000})
    assert r["charge_conc"] > 0.6 and r["n_saturated"] == 1
    r = shape(spark, {(8, 11): 30})
    assert (r["linearity"], r["pca_angle_deg"], r["centroid_wire"], r["centroid_time"]) == (1, None, 8, 11)
    one = frame(spark, [(5,)], "row long")
    none = features.geometry(image(spark, {(0, 0): 0}).withColumnRenamed("event_id", "row").withColumn("frame_area", F.lit(1.0)))
    r = features.with_empty(none, one).first()
    assert (r["n_points"], r["linearity"]) == (0, None)


def sized(spark, w, h, fw, fh):
    return frame(spark, [(0, w, h, fw, fh)], "row long, crop_w long, crop_h long, frame_w long, frame_h long")


def test_windows_and_scales(spark):
    r = frames.window(sized(spark, 90, 64, 94, 68)).first()
    assert (r["win_w_lo"], r["win_w_hi"], r["pad_w"], r["was_cropped"]) == (0, 90, 2, False)
    r = frames.window(sized(spark, 101, 64, 94, 68)).first()
    assert (r["win_w_lo"], r["win_w_hi"], r["was_cropped"]) == (3, 97, True)
    r = frames.with_scale(sized(spark, 400, 300, 288, 176)).first()
    assert r["downscale_factor"] == min(288 / 400, 176 / 300)
    r = frames.with_scale(sized(spark, 50, 40, 288, 176)).first()
    assert (r["downscale_factor"], r["new_w"], r["new_h"]) == (1, 50, 40)


@pytest.mark.parametrize(("w", "h", "nw", "nh"), [(100, 60, 20, 12), (100, 60, 33, 17), (64, 64, 64, 64)])
def test_resize_keeps_flats(spark, w, h, nw, nh):
    rows = [(0, x, y, 7.0, w, h, nw, nh) for x in range(w) for y in range(h)]
    found = frames.resize(frame(spark, rows, "row long, px long, py long, v double, crop_w long, crop_h long, new_w long, new_h long")).collect()
    assert len(found) == nw * nh and all(r["value"] == pytest.approx(7) for r in found)


def test_truth_states_and_ties(spark):
    boxes = frame(spark, [(1, 10), (2, 10), (3, 11)], "row long, event_id long")
    members = frame(spark, [(1, 5, 1.0, 2), (1, 5, 0.0, 0)], "row long, charge long, share double, class int")
    found = {r["row"]: r for r in truth.cluster_truth(members, boxes, frame(spark, [(10,)], "event_id long")).collect()}
    assert [found[k]["n_hits"] for k in (1, 2, 3)] == [2, 0, -1]
    assert [found[k]["dominant_class"] for k in (1, 2, 3)] == [0, -1, -1]  # equal counts: cosmic
    assert [found[k]["percent_nu"] for k in (1, 2, 3)] == [50, None, None]


def test_dominant_is_the_largest_row_first_on_ties(spark):
    rows = [(1, 0, 7, 0.4), (1, 1, 8, 0.4), (2, 0, 7, 0.3), (2, 1, 8, 0.5), (2, 2, 7, 0.3)]
    found = truth.dominant(frame(spark, rows, "hit long, edep_row int, g4_id long, energy_fraction double"), ["hit"])
    assert {r["hit"]: r["g4_id"] for r in found.collect()} == {1: 7, 2: 8}


def test_scores_of_empty_images(spark):
    r = frame(spark, [(1.0, 0.0)], "s double, total double").select(P.scaled_score_training(F.col("s"), F.col("total")), P.scaled_score_analysis(F.col("s"), F.col("total"))).first()
    assert tuple(r) == (0, None)


def test_average_rank_and_spearman(spark):
    rows = frame(spark, [(1.0, 2.0), (1.0, 4.0), (3.0, 4.0), (7.0, 9.0)], "a double, b double")
    assert sorted(r["r"] for r in ranking.value_ranks(rows, "a", "r").collect()) == [1.5, 1.5, 3, 4]
    pdf = rows.toPandas().rank()
    assert ranking.spearman(rows, "a", "b").first()[0] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert ranking.spearman(rows.withColumn("b", F.lit(1.0)), "a", "b").first()[0] is None


def test_auc_with_ties(spark):
    rows = frame(spark, [(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "s double, p boolean")
    assert ranking.auc(rows, "s", F.col("p")).first()["auc"] == (2 + 1.5) / 4
    points = [tuple(r) for r in ranking.roc(rows, "s", F.col("p")).orderBy(F.desc_nulls_first("threshold")).collect()]
    assert points == [(None, 0, 0), (3, 0.5, 0), (2, 1, 0.5), (1, 1, 1)]


def test_charge_normalised_is_flat_on_a_power_law(spark):
    rows = frame(spark, [(3.0 * x**0.5, float(x)) for x in range(1, 2001)] + [(1.0, 0.0)], "raw double, inten double")
    found = scores.charge_normalised(rows).toPandas()
    assert found["norm"].isna().sum() == 1
    assert found.loc[found["inten"] > 100, "norm"].between(0.8, 1.2).all()


def test_efficiency_edges_and_parentheses(spark):
    rows = frame(spark, [(0.5, True), (0.5, False), (1.0, True), (-0.5, False), (-0.5, True)], "v double, p boolean")
    assert tuple(histograms.efficiency(rows, "v", F.col("p"), [0, 1, 2]).first())[2:5] == (2, 1, 0.5)
    assert histograms.efficiency(rows, "v", F.col("p"), [0, 1], absolute=True).first()["n_pass"] == 2
    assert histograms.efficiency(rows, "v", F.col("p"), [0, 1], absolute=True, compat=True).first()["n_pass"] == 3


def test_last_bin_takes_its_edge(spark):
    found = histograms.fixed(frame(spark, [(0.0,), (5.0,), (10.0,)], "v double"), "v", 10)
    assert {r["bin"]: r["n"] for r in found.collect()} == {0: 1, 5: 1, 9: 1}


def test_wires(spark):
    rows = frame(spark, [(0, 0), (1, 0), (2, 0)], "p int, w int")
    start, end = G.wire_ends(F.col("p"), F.col("w"))
    found = [r[0]["y"] for r in rows.select(start).collect()]
    assert found == [pytest.approx(117.153), pytest.approx(-115.213), pytest.approx(-115.53)]
    with pytest.raises(Exception, match="no such plane"):
        frame(spark, [(3, 0)], "p int, w int").select(start).collect()
    with pytest.raises(Exception, match="no such plane"):
        frame(spark, [(0, 2400)], "p int, w int").select(end).collect()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (None, 3), (7, 7)]
    found = {r["node"]: r["component"] for r in graph.connected_components(frame(spark, edges, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0} and found[101] == 100


def test_splits_and_caps(spark):
    rows = spark.range(103).withColumnRenamed("id", "k")
    n = {r["split"]: r["n"] for r in sampling.split(rows, "k").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert n == {"train": round(51.5), "val": 10, "test": 103 - round(51.5) - 10}
    assert sampling.capped(rows.withColumn("g", F.col("k") % 4), ["g"], "k", 5).count() == 20
    assert sampling.batches(rows, "k", 50).groupBy("batch_id").count().count() == 3


def test_confusion_has_guards(spark):
    r = scores.confusion(frame(spark, [(1.0, False)], "s double, p boolean"), "s", F.col("p"), 5).first()
    assert (r["tn"], r["recall"], r["precision"], r["f1"]) == (1, 0, 0, 0)


def test_noise_spares_the_first(spark):
    rows = frame(spark, [(1, [0.5, 0.5, 0.99])], "k long, px array<double>")
    px = rows.select(P.with_noise(F.col("px"), F.col("k"))).first()[0]
    assert px[0] == 0.5 and px[1] > 0.5 and px[2] == 1


def test_epochs():
    assert sampling.whole_batches(100, 32) == 128 and math.isclose(pd.Series([1.0, 3.0]).mean(), 2)
