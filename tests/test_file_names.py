"""Rows keep the identity of their file whatever the path."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import tiles, truth
from tessera.sources import tables

NAMES = ["plain", "with space", "per%cent", "per%20cent", "plus+sign", "ümläut 日本", "a=b", "semi;colon", "[x]"]


@pytest.mark.parametrize("folders", [False, True])
def test_file_ids(spark, tmp_path, folders):
    paths = []
    for k, name in enumerate(n for n in NAMES if n != "[x]"):  # a pattern, in Spark's paths
        folder = tmp_path / f"{name} {k}"
        spark.createDataFrame([(k, j) for j in range(3)], "k int, j int").coalesce(1).write.parquet(str(folder))
        paths.append(str(folder) if folders else str(next(folder.glob("*.parquet"))))
    rows, status = tables.read_files(spark, paths)
    assert [tuple(r) for r in rows.select("file_id", "k", "file").distinct().orderBy("k").collect()] == [(k, k, p) for k, p in enumerate(paths)]
    assert {r["status"] for r in status.collect()} == {"processed"}
    rows, status = tables.read_files(spark, [paths[1], str(tmp_path / "no such"), paths[4]])
    assert [tuple(r) for r in rows.select("file_id", "k").distinct().orderBy("file_id").collect()] == [(0, 1), (1, 4)]


def test_truth_over_files_with_odd_names(spark, tmp_path):
    """Two files of the same event: each cluster meets the hits of its own file only."""
    for k, name in enumerate(("one file", "other+100%")):
        spark.createDataFrame([(1, 5 + k, 5, 10.0, 1.0, 2)], "event_id long, wire long, t long, charge double, share double, class int").coalesce(1).write.parquet(str(tmp_path / name))
    hits, _ = tables.read_files(spark, [str(tmp_path / "one file"), str(tmp_path / "other+100%")])
    boxes = spark.createDataFrame([(f, 10 + f, 1, 0, 18, 0, 16) for f in range(2)], "file_id int, row long, event_id long, wire_lo long, wire_hi long, time_lo long, time_hi long")
    from tessera.operators import clusters

    members = clusters.inside(boxes, hits, keys=("file_id", "event_id"))
    found = truth.cluster_truth(members, boxes, hits, event=("file_id", "event_id")).orderBy("row").collect()
    assert [(r["row"], r["n_hits"]) for r in found] == [(10, 1), (11, 1)]
    assert tiles.select_plane(hits.withColumn("local_plane", F.lit(2))).count() == 2
