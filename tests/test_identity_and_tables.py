"""Events of several files, particles of several events, ragged images, and files."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import clusters as C
from tessera.operators import frames, models, sampling, scores, tiles
from tessera.operators import truth as H
from tessera.plans import truth_table as full
from tessera.sources import storage, tables


def test_particles_belong_to_their_event(spark):
    """Id 7 is a muon in event 1 and a pion in event 2."""
    hits = spark.createDataFrame([(10, 1), (20, 2), (30, 2)], "hit long, event_id long")
    deposits = spark.createDataFrame([(10, 0, 7, 0.5), (20, 0, 7, 0.5)], "hit long, edep_row int, g4_id long, energy_fraction double")
    particles = spark.createDataFrame([(1, 7, 13), (2, 7, -211)], "event_id long, g4_id long, g4_pdg int")
    found = H.hit_classes(hits, deposits, particles, ["hit"]).collect()
    assert sorted((r["hit"], r["class"]) for r in found) == [(10, 2), (20, 3), (30, 0)]
    twice = particles.union(particles.limit(1))
    with pytest.raises(Exception, match="more than one row"):
        H.hit_classes(hits, deposits, twice, ["hit"]).collect()


def detector(spark, file_id, kind):
    """One event with number 5: a line of pixels, hits on it, a vertex. kind: the particle's code."""
    points = [(file_id, 5, w, 16 * (w // 18) % 640 + 3, 40.0) for w in range(40, 150)]
    pixels = spark.createDataFrame(points, "file_id int, event_id long, wire long, t long, adc double")
    hits = pixels.withColumns({"hit": F.col("wire") + 1000 * file_id, "charge": F.lit(10).cast("long")})
    deposits = hits.filter("wire % 2 = 0").select("hit", F.lit(0).alias("edep_row"), F.lit(7).cast("long").alias("g4_id"), F.lit(0.5).alias("energy_fraction"))
    particles = spark.createDataFrame([(file_id, 5, 7, kind)], "file_id int, event_id long, g4_id long, g4_pdg int")
    events = spark.createDataFrame([(file_id, 5, 14, file_id == 0, 1.5, 60 + file_id, 50)], "file_id int, event_id long, nu_pdg int, is_cc boolean, nu_energy_gev double, nu_vtx_wire long, nu_vtx_time long")
    return pixels, hits, deposits, particles, events


def table_of(pixels, hits, deposits, particles, events):
    keys = ["file_id", "event_id"]
    kept = tiles.keep(tiles.catalog(pixels, (18, 16), keys))
    found = C.boxes(C.with_state(C.summarise(C.label(kept, keys=keys), keys=keys)))
    found = found.withColumn("row", F.col("file_id") * 100 + F.col("cluster_id"))
    true = H.hit_classes(H.hit_shares(hits, deposits, ["hit"]), deposits, particles, ["hit"], keys)
    return full.truth_table(found, pixels, true, events, event=keys)


def test_events_of_two_files_with_one_number_stay_apart(spark):
    one, two = detector(spark, 0, 13), detector(spark, 1, 2212)
    both = table_of(*(a.unionByName(b) for a, b in zip(one, two, strict=True)))
    apart = table_of(*one).unionByName(table_of(*two))
    shown = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert both.count() == 2 and shown(both) == shown(apart)
    rows = {r["source_file_id"]: r for r in both.collect()}
    assert (rows[0]["n_hits_muon"], rows[1]["n_hits_proton"]) == (55, 55) and rows[0]["n_hits"] == rows[1]["n_hits"] == 110
    tracks = H.tracks_per_tile(one[1].unionByName(two[1]), one[2].unionByName(two[2]), ["hit"], event=["file_id", "event_id"])
    assert tracks.groupBy("file_id").count().count() == 2


def test_vertex_of_an_event_without_hits_is_unknown(spark):
    rows = spark.createDataFrame([(1, 5, 0, 100, 0, 100, 10.0, 10.0), (2, 6, 0, 100, 0, 100, 10.0, 10.0)], "row long, event_id long, wire_lo long, wire_hi long, time_lo long, time_hi long, centroid_wire double, centroid_time double")
    events = spark.createDataFrame([(5, 50, 50), (6, 50, 50)], "event_id long, nu_vtx_wire long, nu_vtx_time long")
    found = H.vertices(rows, events, spark.createDataFrame([(5,)], "event_id long")).collect()
    assert {r["row"]: r["vtx_in_frame"] for r in found} == {1: 1, 2: -1}


def test_dense_adds_repeated_pixels_up(spark):
    rows = spark.createDataFrame([(0, 0, 0, 10.0), (0, 0, 0, 5.0), (0, 17, 15, 1.0), (0, 3, 4, 2.0), (1, 20, 20, 7.0)], "event_id long, wire long, t long, adc double")
    found = {(r["event_id"], r["tile_index"]): r["px"] for r in tiles.dense(rows, (18, 16)).collect()}
    a, b = found[0, 0], found[1, 41]
    assert len(a) == len(b) == 288 and (a[0], a[3 * 16 + 4], a[-1], sum(a)) == (15, 2, 1, 18) and (b[2 * 16 + 4], sum(b)) == (7, 7)


def test_ragged_images(spark):
    rng = random.Random(1)
    boxes = {1: (3, 5), 2: (10, 2), 4: (1, 1)}
    points = {(r, rng.randrange(w), rng.randrange(h)): float(rng.randrange(1, 9)) for r, (w, h) in boxes.items() for _ in range(8)}
    df = spark.createDataFrame([(r, *boxes[r], x, y, v) for (r, x, y), v in points.items()], "row long, crop_w long, crop_h long, x long, y long, adc double")
    images = tiles.packed(df).cache()
    assert {r["row"]: len(r["px"]) for r in images.collect()} == {1: 15, 2: 20, 4: 1}
    assert {(r["row"], r["x"], r["y"]): r["adc"] for r in tiles.unpacked(images).collect()} == points
    assert sorted(map(tuple, tiles.offsets(images).collect())) == [(1, 0, 15), (2, 15, 35), (4, 35, 36)]
    assert tiles.image(images, 2).first()["crop_w"] == 10 and tiles.image(images, 3).count() == 0
    assert sorted(r["row"] for r in tiles.iterate(images)) == [1, 2, 4]
    places = {r["row"]: (r["grid_row"], r["grid_col"], r["left"], r["top"]) for r in tiles.montage(images, "row", 2).collect()}
    assert places == {1: (0, 0, 0, 0), 2: (0, 1, 11, 0), 4: (1, 0, 0, 6)}


def test_tiles_of_all_sizes_in_one_pass(spark):
    rows = spark.createDataFrame([(0, 5, 5, 60.0), (0, 3000, 600, 40.0), (1, 20, 20, 5.0)], "event_id long, wire long, t long, adc double")
    wide = tiles.catalog_sizes(rows)
    for w, t in ((18, 16), (64, 32), (864, 64)):
        own = wide.filter(F.col("size") == f"{w}x{t}").drop("size")
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, tiles.catalog(rows, (w, t)).collect()))
    got = {r["size"]: (r["kept"], r["total"]) for r in tiles.kept_shares(wide, rows).collect()}
    assert got == {"18x16": (1, 15360), "64x32": (1, 2160), "864x64": (1, 80)}
    assert tiles.count_tiles(rows, (864, 64), only=[1]).first()["total"] == 40
    scan = {r["threshold"]: (r["kept"], r["total"]) for r in tiles.threshold_scan(tiles.catalog(rows, (864, 64)), (0, 50), (864, 64)).collect()}
    assert scan == {0: (80, 80), 50: (1, 80)}
    with pytest.raises(Exception, match="wires in an event"):
        tiles.check_wires(rows).collect()
    assert tiles.check_wires(rows, wires=1).filter("event_id = 1").first()["n_wires"] == 1


def test_file_states(spark, tmp_path):
    for k in range(3):
        spark.range(k + 1).withColumn(f"own{k}", F.lit(k)).write.parquet(str(tmp_path / f"f{k}"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    paths = [str(tmp_path / x) for x in ("f0", "broken", "f1", "none", "f2")]
    rows, status = tables.read_files(spark, paths)
    assert [tuple(r) for r in status.collect()] == [(paths[0], "processed"), (paths[1], "failed"), (paths[2], "processed"), (paths[3], "missing"), (paths[4], "processed")]
    assert sorted((r["file_id"], r["file"], r["n"]) for r in rows.groupBy("file_id", "file").agg(F.count("*").alias("n")).collect()) == [(0, paths[0], 1), (1, paths[2], 2), (2, paths[4], 3)]
    assert {"own0", "own1", "own2"} <= set(rows.columns)
    whole, status = tables.read_files(spark, [paths[0], paths[2]], missing="error")
    assert whole.count() == 3 and status.filter("status = 'processed'").count() == 2
    with pytest.raises(FileNotFoundError):
        tables.read_files(spark, paths, missing="error")
    assert tables.read_files(spark, [])[0] is None and tables.read_files(spark, paths[3:4])[0] is None
    assert tables.first_readable(spark, [paths[3], paths[1], paths[2]]) == paths[2]
    with pytest.raises(FileNotFoundError):
        tables.first_readable(spark, paths[3:4])


def test_checked_writes_and_number_format(spark, tmp_path):
    tables.write_checked(spark.range(5), str(tmp_path / "a"), 5)
    with pytest.raises(AssertionError, match="has 5 rows, not 6"):
        tables.write_each({"b": spark.range(5)}, str(tmp_path), {"b": 6})
    tables.write(spark.range(10).coalesce(1), str(tmp_path / "c"), rows_per_file=3)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 4 and tables.dense_bytes(10, 288) == 11520
    values = [0.0, -0.0, 1.5, 2.0, -3.25, 1 / 3, 123456.0, 1234567.0, 1e6, 999999.5, 0.0001234, 0.00001234, 1e-300, 6.02e23, 100.0, float("nan"), float("inf"), float("-inf"), 12345.6789]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(99, None)], "k int, v double")
    found = {r["k"]: r["s"] for r in df.select("k", tables.shortest(F.col("v")).alias("s")).collect()}
    assert found == {k: "%.6g" % v for k, v in enumerate(values)} | {99: None}


def test_stored_tables(spark, tmp_path):
    a = storage.stored(spark.range(4))
    both = storage.stored_in_turn(spark.range(k, k + 2) for k in (0, 10))
    assert a.count() == 4 and sorted(r["id"] for r in both.collect()) == [0, 1, 10, 11]
    folder = {f.rpartition("/")[0] for f in a.inputFiles()}
    storage.discard(a)
    assert folder and all(spark.read.parquet(p).count() == 0 for p in folder)
    assert storage.stored_in_turn(iter(())) is None
    kept = spark.range(3)
    kept.write.parquet(str(tmp_path / "own"))
    storage.discard(spark.read.parquet(str(tmp_path / "own")))  # not one of stored()'s
    assert spark.read.parquet(str(tmp_path / "own")).count() == 3


def test_small_operators(spark):
    big = spark.createDataFrame([((1 << 62) + k,) for k in range(20)], "k long")
    assert sampling.split(big, "k").groupBy("split").count().count() == 3
    n = {r["split"]: r["count"] for r in sampling.nested_split(spark.range(120), "id").groupBy("split").count().collect()}
    assert n == {"test": 48, "train": 60, "val": 12}
    assert sampling.reservoir(spark.range(100), "id", 7).count() == 7
    assert [r["id"] for r in sampling.shuffled(spark.range(30), "id").collect()] != list(range(30)) and sampling.shuffled(spark.range(30), "id").count() == 30
    assert sampling.pick(spark.range(9), "id", 4).first()["id"] == 4 and sampling.pick(spark.range(9), "id", 44).count() == 0
    assert sampling.pick(spark.range(9), "id", seed=1).first() == sampling.pick(spark.range(9).repartition(3), "id", seed=1).first()
    ids = spark.createDataFrame([(0,), (1,), (2,)], "p int")
    assert [r[0] for r in ids.select(G.n_wires(F.col("p"))).collect()] == [2400, 2400, 3456]
    assert [r[0] for r in ids.select(G.category_name(F.col("p"))).collect()] == ["pion", "muon", "kaon"]
    losses = spark.createDataFrame([(0, 0, 1.0), (0, 0, 3.0), (0, 1, 6.0), (1, 0, 1.0)], "epoch int, batch int, loss double")
    assert {r["epoch"]: r["loss"] for r in scores.epoch_loss(losses).collect()} == {0: 4.0, 1: 1.0}
    history = spark.createDataFrame([(2, 0.5), (1, 0.5), (0, 0.9)], "epoch int, val_loss double")
    assert tuple(scores.best_epoch(history).first()) == (1, 0.5)
    pairs = spark.createDataFrame([(1.1, 1.0), (2.0, 4.0)], "a double, b double")
    assert scores.max_difference(pairs, "a", "b", relative=True).first()[0] == pytest.approx(0.5)
    for name, n in (("any", 3), ("neutrino", 1), ("cropped", 2)):
        df = spark.createDataFrame([(60.0, True), (50.0, True), (None, False)], "percent_nu double, was_cropped boolean")
        assert scores.pool(df, name).count() == n
    with pytest.raises(ValueError, match="one of"):
        scores.pool(df, "other")
    images = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0])], "k int, px array<double>")
    assert [r["k"] for r in tiles.lit_only(images).collect()] == [2]
    assert frames.with_raw(spark.createDataFrame([(0, 7)], "row long, raw_index long"), spark.createDataFrame([(7, "x")], "row long, name string")).first()["name"] == "x"


def test_dense_autoencoder(spark):
    weights = models.dense_weights((784, 64, 784))
    assert models.dense_parameter_count((784, 64, 784)) == sum(v.size for v in weights.values()) == 784 * 64 + 64 + 64 * 784 + 784
    deep = models.DENSE_LAYERS
    assert deep[0] == deep[-1] == 784 and min(deep) == 16 and deep == deep[::-1]
    rows = spark.createDataFrame([(k, [((k + i) % 7) / 7 for i in range(784)]) for k in range(3)], "row long, px array<double>")
    for r in models.dense_scores(rows, weights).collect():
        x = [((r["row"] + i) % 7) / 7 for i in range(784)]
        out = models.dense_reconstruct(weights, [x])[0]
        assert r["raw"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(x, out, strict=True)) / 784, rel=1e-4) and 0 <= min(out) and max(out) <= 1


def test_dense_training(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = (rng.random((60, 3)) @ rng.random((3, 12)) / 3).astype(np.float32)
    weights = models.dense_weights((12, 5, 12), seed=2)
    found, loss = models.dense_gradients(weights, x)
    moved = {k: v.copy() for k, v in weights.items()}
    moved["weight0"][2, 3] += 1e-2
    assert (models.dense_gradients(moved, x)[1] - loss) / 1e-2 == pytest.approx(found["weight0"][2, 3], rel=0.1, abs=1e-3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row long, px array<float>").repartition(3)
    after, losses = models.dense_fit(rows, weights, steps=12, rate=0.03)
    assert losses[0] == pytest.approx(loss / 60, rel=1e-4) and losses[-1] < losses[0]
    mean = models.dense_scores(rows, after).agg(F.avg("raw")).first()[0]
    assert mean < losses[0]
