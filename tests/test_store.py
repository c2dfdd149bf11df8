"""The event store, nested events, and boxes off the tile grid."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, truth
from tessera.plans import queries
from tessera.sources import store
from tests.compare import both


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def kept(spark):
    made = store.new_store(spark, 3)
    hits = spark.createDataFrame([(e, h, 2, (e * 31 + h * 7) % 90, (e * 17 + h * 5) % 64, float(h)) for e in range(7) for h in range(40)], "event_id long, hit_id long, local_plane int, wire long, t long, adc double")
    made.add("hits", hits)
    made.add("deposits", spark.createDataFrame([(e, h, r, (h + r) % 4, 0.1 * (r + 1)) for e in range(6) for h in range(0, 40, 2) for r in range(2)], "event_id long, hit_id long, edep_row int, g4_id long, energy_fraction double"))
    made.add("particles", spark.createDataFrame([(e, g, (13, 211, 2212, 11)[(g + e) % 4]) for e in range(7) for g in range(4)], "event_id long, g4_id long, g4_pdg long"))
    yield made, hits
    made.drop()


def test_joins_and_groups_need_no_exchange(spark, kept):
    made, _ = kept
    keys = ["event_id", "hit_id"]
    made.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = truth.hit_classes(truth.hit_shares(made["hits"], made["deposits"], keys), made["deposits"], made["particles"], keys)
    held = made.add("classes", found, True)
    assert "Exchange" not in plan(found) and held.count() == 280
    plain = truth.hit_classes(truth.hit_shares(*(spark.createDataFrame(made[n].collect(), made[n].schema) for n in ("hits", "deposits")), keys), *(spark.createDataFrame(made[n].collect(), made[n].schema) for n in ("deposits", "particles")), keys)
    order = lambda df: sorted(tuple(r) for r in df.select("event_id", "hit_id", "share", "class").collect())
    assert order(held) == order(plain)
    tiles = made["hits"].groupBy("event_id", (F.floor(F.col("wire") / 18) * 40 + F.floor(F.col("t") / 16)).alias("tile_index")).agg(F.count("*").alias("n"))
    boxes = made.add("boxes", clusters.boxes(clusters.with_state(clusters.summarise(clusters.label(tiles)), min_tiles=1)))
    members = clusters.inside(boxes, made["hits"].select("event_id", "wire", "t", "hit_id"))
    assert "Exchange" not in plan(members) and members.select("event_id", "hit_id").distinct().count() == 280


def test_nested(kept):
    made, hits = kept
    rows = {r["event_id"]: r for r in made.nested("hits", "deposits", "particles").collect()}
    assert {e: (len(r["hits"]), len(r["deposits"]), len(r["particles"])) for e, r in rows.items()} == {e: (40, 40 if e < 6 else 0, 4) for e in range(7)}
    assert [h["hit_id"] for h in rows[3]["hits"]] == list(range(40))
    some = {r["event_id"]: len(r["hits"]) for r in made.nested("particles", "hits", where={"hits": F.col("hit_id") < 3}).collect()}
    assert some == dict.fromkeys(range(7), 3)
    with pytest.raises(ValueError, match="there is a table"):
        made.add("hits", hits)


def test_nested_in_parts(kept):
    """No array is longer than `most`, and every row is in one of them."""
    made, _ = kept
    rows = made.nested("hits", "deposits", "particles", most=7).collect()
    assert max(len(r[n]) for r in rows for n in ("hits", "deposits", "particles")) == 7
    assert sorted({r["part"] for r in rows if r["event_id"] == 3}) == list(range(6)) and len(rows) == 42
    for name in ("hits", "deposits", "particles"):
        found = sorted((r["event_id"], *x) for r in rows for x in r[name])
        table = made[name]
        assert found == sorted(tuple(r) for r in table.select("event_id", *(c for c in table.columns if c != "event_id")).collect())


def test_nested_events_holds_no_event_whole(spark, monkeypatch):
    plain, seen = store.EventStore.nested, []

    def nested(self, *names, **options):
        out = plain(self, *names, **options)
        seen.append(out.select(*(F.max(F.size(n)) for n in names)).first())
        return out

    monkeypatch.setattr(store.EventStore, "nested", nested)
    monkeypatch.setattr(queries, "NESTED", 4)
    got, want = both(spark, "nested_events", queries.QUERIES["nested_events"], queries.SQL["nested_events"])
    assert got == want and max(seen[0]) == 4


def test_truth_table_exchanges_nothing_by_event(spark):
    df = queries._store_truth(spark, "/root/testdata/sf0.001")
    assert not re.findall(r"Exchange hashpartitioning\(event_id#\d+L?,", plan(df))
    own = queries._event_store(spark, "/root/testdata/sf0.001")
    own.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Exchange" not in plan(queries._hits_of(own))


def test_boxes_off_the_grid(spark):
    """Every point in its boxes once, whatever their sides."""
    points = [(e, w, t) for e in range(2) for w in range(0, 60, 3) for t in range(0, 50, 4)]
    boxes = [(0, 1, 5, 20, 7, 33), (0, 2, 0, 18, 0, 16), (0, 3, 17, 19, 15, 17), (1, 4, 6, 6, 0, 10), (1, 5, 3, 4, 0, 1), (1, 6, 1, 60, 1, 50), (1, 7, 9, 3, 0, 9)]
    p = spark.createDataFrame(points, "event_id long, wire long, t long")
    b = spark.createDataFrame(boxes, "event_id long, row long, wire_lo long, wire_hi long, time_lo long, time_hi long")
    got = sorted((r["row"], r["wire"], r["t"]) for r in clusters.inside(b, p).collect())
    assert got == sorted((r, w, t) for e, r, a, c, x, y in boxes for f, w, t in points if e == f and a <= w < c and x <= t < y)


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    """What a task holds of few, large events is bounded: buckets are by slices too, and as many as the rows need."""
    assert store.new_store(spark).buckets == 4 and store.new_store(spark, rows=9 * store.ROWS + 1).buckets == 10
    monkeypatch.setattr(store, "ROWS", 500)
    made = queries._event_store(spark, "/root/testdata/sf0.001")
    each = made["hits"].select("event_id", F.spark_partition_id().alias("b")).groupBy("event_id").agg(F.countDistinct("b").alias("n")).collect()
    assert made.buckets == 12 and min(r["n"] for r in each) > 1 and made.spark.conf.get("spark.sql.shuffle.partitions") == "12"


def test_a_tile_has_several_buckets(spark, monkeypatch):
    """Hits of a tile that many share go to several tasks, those of a pixel to one."""
    monkeypatch.setattr(store, "ROWS", 500)
    made = queries._event_store(spark, "/root/testdata/sf0.001")
    tiles, pixels = {}, {}
    for r in made["hits"].select("event_id", "slice", "wire", "t", F.spark_partition_id().alias("b")).collect():
        tiles.setdefault((r["event_id"], r["wire"] // 18, r["t"] // 16), []).append(r["b"])
        pixels.setdefault((r["event_id"], r["wire"], r["t"]), set()).add(r["b"])
    assert len(set(max(tiles.values(), key=len))) > 3 and {len(b) for b in pixels.values()} == {1}
