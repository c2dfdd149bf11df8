"""The detector tables as views of the star-schema tables, for Spark and, as common table expressions, for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.operators import clusters as C
from tessera.operators import tiles as T
from tessera.operators import truth as H
from tessera.operators.scores import mean_image

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SIZE = (18, 16)
TRACK, STEP, EVENT = "(l_suppkey % 6)", "(l_partkey % 200)", "(l_orderkey % 32)"
#: Where hits lie: six straight tracks an event, and noise. `//` is integer division.
WIRE = f"CASE WHEN l_linenumber = 7 THEN ({STEP}*17 + {EVENT}*577 + {TRACK}*1009) % 3456 ELSE ({EVENT}*577 + {TRACK}*613 + {STEP}*(1 + {TRACK} % 3)) % 3456 END"
TIME = f"CASE WHEN l_linenumber = 7 THEN ({STEP}*29 + {TRACK}*211 + {EVENT}*89) % 640 WHEN {TRACK} = 5 THEN ({EVENT}*89 + ({STEP}*5)//2) % 640 ELSE ({EVENT}*89 + {TRACK}*131 + ({STEP}*({TRACK} % 4))//2 + l_linenumber % 2) % 640 END"
PDGS = (13, -13, 211, -211, 2212, 11, 22)


def spark_expr(text: str):
    return F.expr(text.replace("//", " div ")).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    out = rows.select(
        *KEYS, spark_expr(EVENT).alias("event_id"), spark_expr(WIRE).alias("wire"), spark_expr(TIME).alias("t"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("local_plane"),
        F.col("l_quantity").alias("adc"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("integral"),
        "l_linestatus", F.round(F.col("l_discount") * 100).cast("int").alias("tenths0"), F.round(F.col("l_tax") * 100).cast("int").alias("tenths1"),
    )
    return out.withColumn("local_time", F.col("t") * 10 + F.col("l_linenumber"))


def cut_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cut(T.sum_pixels(hits(spark, sf_dir)))


def tiles(spark: SparkSession, sf_dir: str, size: tuple[int, int] = SIZE) -> DataFrame:
    return T.catalog(cut_pixels(spark, sf_dir), size)


def kept_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.keep(tiles(spark, sf_dir))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all states with their pixel boxes and a row number."""
    found = C.boxes(C.with_state(C.summarise(C.label(kept_tiles(spark, sf_dir)))))
    return found.withColumn("row", F.col("event_id") * 100000 + F.col("cluster_id"))


def kept_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).filter("state = 'kept'")


def cluster_pixels(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    return C.inside(kept_clusters(spark, sf_dir) if found is None else found, cut_pixels(spark, sf_dir).filter("adc > 0"))


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).filter("l_linestatus = 'F'")
    two = F.array(F.struct(F.lit(0).alias("r"), (F.col("l_suppkey") % 6 + 1).alias("g"), F.col("tenths0").alias("f")), F.struct(F.lit(1).alias("r"), (F.col("l_partkey") % 10).alias("g"), F.col("tenths1").alias("f")))
    return rows.select(*KEYS, F.explode(two).alias("d")).select(*KEYS, F.col("d.r").alias("edep_row"), F.col("d.g").alias("g4_id"), (F.col("d.f") / 10).alias("energy_fraction"))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event has particles of the same ids, of other kinds."""
    rows = table(spark, sf_dir, "supplier").withColumn("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    return rows.select("event_id", F.col("s_suppkey").alias("g4_id"), F.get(F.array(*map(F.lit, PDGS)), ((F.col("s_nationkey") + F.col("event_id")) % 7).cast("int")).alias("g4_pdg"))


def true_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane-2 hits with charge, share and class."""
    rows = T.select_plane(hits(spark, sf_dir)).withColumn("charge", P.hit_charge(F.col("integral")))
    found = deposits(spark, sf_dir)
    return H.hit_classes(H.hit_shares(rows, found, KEYS), found, particles(spark, sf_dir), KEYS)


def neutrinos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey < 31")
    return rows.select(
        F.col("o_orderkey").alias("event_id"), F.lit(14).alias("nu_pdg"), (F.col("o_orderstatus") == "F").alias("is_cc"), (F.col("o_totalprice") / 100000).alias("nu_energy_gev"),
        (F.col("o_custkey") * 37 % 3456).alias("nu_vtx_wire"), P.tick_pixel(F.col("o_custkey") * 61 % 6400).alias("nu_vtx_time"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("embedding", lambda v: F.floor(F.abs(v.cast("double")) * 400).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", px.alias("px"))


def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """images with rec: the mean image of the label. Labels are few; each has one short array."""
    rows = images(spark, sf_dir)
    means = mean_image(rows, "px", ("label",)).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("rec"))
    return rows.join(means, "label")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.col("value").alias("raw"), (F.col("event_id") * 7919 % 5000 + 10).cast("double").alias("inten"), (F.col("event_type") == "error").alias("positive"), "event_type")


CTES = {
    "hits": f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {EVENT} AS event_id, {WIRE} AS wire, {TIME} AS t,
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS local_plane, l_quantity AS adc, CAST(round(l_extendedprice * 100) AS BIGINT) AS integral,
      l_linestatus, CAST(round(l_discount * 100) AS INTEGER) AS tenths0, CAST(round(l_tax * 100) AS INTEGER) AS tenths1 FROM lineitem""",
    "pixels": "SELECT event_id, wire, t, sum(adc) AS adc FROM hits GROUP BY event_id, wire, t",
    "cut": "SELECT event_id, wire, t, CASE WHEN adc < 10 THEN 0.0::DOUBLE ELSE least(adc, 100.0::DOUBLE) END AS adc FROM pixels",
    "tiles": "SELECT event_id, (wire // 18) * 40 + t // 16 AS tile_index, sum(adc) AS charge, count(*) FILTER (WHERE adc <> 0) AS occupancy FROM cut GROUP BY 1, 2",
    "kept": "SELECT * FROM tiles WHERE charge >= 50",
    "reach": """SELECT event_id, tile_index AS start, tile_index AS tile FROM kept
      UNION SELECT r.event_id, r.start, k.tile_index FROM reach r JOIN kept k ON k.event_id = r.event_id
        AND abs(k.tile_index // 40 - r.tile // 40) <= 1 AND abs(k.tile_index % 40 - r.tile % 40) <= 1""",
    "roots": "SELECT event_id, tile AS tile_index, min(start) AS root FROM reach GROUP BY 1, 2",
    "labelled": "SELECT *, dense_rank() OVER (PARTITION BY event_id ORDER BY root) AS label FROM roots",
    "summed": """SELECT event_id, label AS cluster_id, count(*) AS n_tiles, min(tile_index // 40) AS row_lo, max(tile_index // 40) + 1 AS row_hi,
      min(tile_index % 40) AS col_lo, max(tile_index % 40) + 1 AS col_hi FROM labelled GROUP BY 1, 2""",
    "clusters": """SELECT *, event_id * 100000 + cluster_id AS row, time_hi - time_lo AS crop_h, wire_hi - wire_lo AS crop_w FROM (
      SELECT *, CASE WHEN n_tiles < 3 THEN 'small' WHEN n_tiles > 300 OR row_hi - row_lo > 0.6::DOUBLE * 192 OR col_hi - col_lo > 0.6::DOUBLE * 40 THEN 'giant' ELSE 'kept' END AS state,
        greatest(0, (row_lo - 1) * 18) AS wire_lo, least(3456, (row_hi + 1) * 18) AS wire_hi, greatest(0, (col_lo - 1) * 16) AS time_lo, least(640, (col_hi + 1) * 16) AS time_hi FROM summed)""",
    "kc": "SELECT * FROM clusters WHERE state = 'kept'",
    "cpix": "SELECT k.row, p.wire, p.t, p.adc FROM kc k JOIN cut p ON p.event_id = k.event_id AND p.adc > 0 AND p.wire >= k.wire_lo AND p.wire < k.wire_hi AND p.t >= k.time_lo AND p.t < k.time_hi",
    "targets": """SELECT pct, CAST(ceil(w) + ceil(w) % 2 AS BIGINT) AS frame_w, CAST(ceil(h) + ceil(h) % 2 AS BIGINT) AS frame_h FROM (
      SELECT 50 AS pct, quantile_cont(crop_w, 0.5) AS w, quantile_cont(crop_h, 0.5) AS h FROM kc UNION ALL SELECT 75, quantile_cont(crop_w, 0.75), quantile_cont(crop_h, 0.75) FROM kc)""",
    "wins": """SELECT *, wl AS win_w_lo, wl + least(crop_w, frame_w) AS win_w_hi, hl AS win_h_lo, hl + least(crop_h, frame_h) AS win_h_hi FROM (
      SELECT k.*, pct, frame_w, frame_h, greatest(crop_w - frame_w, 0) // 2 AS wl, greatest(crop_h - frame_h, 0) // 2 AS hl,
        greatest(frame_w - crop_w, 0) // 2 AS pad_w, greatest(frame_h - crop_h, 0) // 2 AS pad_h, crop_w > frame_w OR crop_h > frame_h AS was_cropped FROM kc k, targets)""",
    "edep": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 0 AS edep_row, l_suppkey % 6 + 1 AS g4_id, tenths0 AS tenths FROM hits WHERE l_linestatus = 'F'
      UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 1, l_partkey % 10, tenths1 FROM hits WHERE l_linestatus = 'F'""",
    "part_pdg": "SELECT e AS event_id, s_suppkey AS g4_id, [13, -13, 211, -211, 2212, 11, 22][(s_nationkey + e) % 7 + 1] AS g4_pdg FROM supplier, (SELECT unnest(range(32)) AS e)",
    "dom": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY tenths DESC, edep_row) AS r FROM edep) WHERE r = 1",
    "shares": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(tenths) / 10.0::DOUBLE)) AS share FROM edep GROUP BY ALL",
    "thits": """SELECT h.*, abs(h.integral) AS charge, coalesce(s.share, 0.0::DOUBLE) AS share, d.g4_id,
      CASE WHEN d.g4_id IS NULL THEN 0 WHEN abs(p.g4_pdg) = 13 THEN 2 WHEN abs(p.g4_pdg) = 211 THEN 3 WHEN abs(p.g4_pdg) = 2212 THEN 4 ELSE 1 END AS class
      FROM hits h LEFT JOIN shares s USING (l_orderkey, l_partkey, l_suppkey, l_linenumber) LEFT JOIN dom d USING (l_orderkey, l_partkey, l_suppkey, l_linenumber)
      LEFT JOIN part_pdg p ON p.event_id = h.event_id AND p.g4_id = d.g4_id WHERE local_plane = 2""",
    "nus": """SELECT o_orderkey AS event_id, 14 AS nu_pdg, o_orderstatus = 'F' AS is_cc, o_totalprice / 100000 AS nu_energy_gev, o_custkey * 37 % 3456 AS nu_vtx_wire,
      (o_custkey * 61 % 6400) // 10 AS nu_vtx_time FROM orders WHERE o_orderkey < 31""",
    "images": "SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 400) AS DOUBLE)) AS px FROM embeddings",
    "el": "SELECT vec_id, label, unnest(px) AS v, unnest(range(len(px))) AS pos FROM images",
    "means": "SELECT label, pos, avg(v) AS mean FROM el GROUP BY 1, 2",
    "mses": "SELECT vec_id, label, avg((v - mean) * (v - mean)) AS mse, sum(v) AS total FROM el JOIN means USING (label, pos) GROUP BY 1, 2",
    "sc": "SELECT event_id, value AS raw, CAST(event_id * 7919 % 5000 + 10 AS DOUBLE) AS inten, event_type = 'error' AS positive, event_type FROM events",
    "lg": "SELECT log10(inten) AS li, log10(raw) AS lr FROM sc WHERE raw > 0 AND inten > 0",
    "edges": f"SELECT DISTINCT unnest(quantile_cont(li, [{', '.join(repr(k / 40) for k in range(41))}])) AS e FROM lg",
    "knots": """SELECT quantile_cont(li, 0.5) AS x, quantile_cont(lr, 0.5) AS y FROM (SELECT li, lr, least((SELECT count(*) FROM edges WHERE e <= li) - 1, (SELECT count(*) FROM edges) - 2) AS b FROM lg)
      GROUP BY b HAVING count(*) >= 20""",
    "wires": "SELECT DISTINCT l_partkey % 3 AS plane, (l_partkey * 7 + l_suppkey) % 2400 AS wire FROM lineitem",
    "ends": """SELECT plane, wire, CASE plane WHEN 0 THEN greatest(117.153::DOUBLE - 0.34641::DOUBLE * wire, -115.505::DOUBLE) WHEN 1 THEN least(-115.213::DOUBLE + 0.34641::DOUBLE * wire, 117.445::DOUBLE) ELSE -115.53::DOUBLE END AS y0,
      CASE plane WHEN 2 THEN 0.25::DOUBLE + 0.3::DOUBLE * wire ELSE greatest(-402.941::DOUBLE + 0.6::DOUBLE * wire, 0.0352608::DOUBLE) END AS z0,
      CASE plane WHEN 0 THEN least(715.8006::DOUBLE - 0.3464::DOUBLE * wire, 117.445::DOUBLE) WHEN 1 THEN greatest(-713.8606::DOUBLE + 0.3464::DOUBLE * wire, -115.505::DOUBLE) ELSE 117.47::DOUBLE END AS y1,
      CASE plane WHEN 2 THEN 0.25::DOUBLE + 0.3::DOUBLE * wire ELSE least(0.541::DOUBLE + 0.6::DOUBLE * wire, 1036.96::DOUBLE) END AS z1 FROM wires""",
    "wpairs": "SELECT a.plane AS plane_a, a.wire AS wire_a, b.plane AS plane_b, b.wire AS wire_b, a.y0 AS ay0, a.z0 AS az0, a.y1 AS ay1, a.z1 AS az1, b.y0 AS by0, b.z0 AS bz0, b.y1 AS by1, b.z1 AS bz1 FROM ends a JOIN ends b ON a.wire = b.wire AND a.plane < b.plane",
}


def with_views(query: str) -> str:
    """query after the expressions that it needs."""
    needed: set[str] = set()
    todo = [query]
    while todo:
        for name in set(re.findall(r"\w+", todo.pop())) & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    if not needed:
        return query
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in CTES.items() if n in needed) + "\n" + query
