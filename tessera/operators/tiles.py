"""Images as sparse pixel rows, and their tiles. Keys are columns: file and event, then tile_index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.operators.ranking import running, value_ranks


def sum_pixels(hits: DataFrame, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """keys, wire, t, adc: hits of one pixel added up."""
    return hits.groupBy(*keys, "wire", "t").agg(F.sum(F.col("adc").cast("double")).alias("adc"))


def select_plane(hits: DataFrame, plane: int = 2) -> DataFrame:
    return hits.filter(F.col("local_plane") == plane)


def check_wires(rows: DataFrame, wires: int = P.WIRES, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """Events and their wire counts; an error if one has not exactly `wires` of them."""
    n = rows.groupBy(*keys).agg(F.countDistinct("wire").alias("n_wires"))
    wrong = F.concat(F.lit("wires in an event: "), F.col("n_wires").cast("string"))
    return n.withColumn("n_wires", F.when(F.col("n_wires") == wires, F.col("n_wires")).otherwise(F.raise_error(wrong).cast("long")))


def downsample(ticks: DataFrame, factor: int = P.FACTOR, keys: Iterable[str] = ("event_id", "wire")) -> DataFrame:
    """Sums of blocks of `factor` ticks; ticks: keys, tick, adc. A ragged last block is summed as it is."""
    return ticks.groupBy(*keys, P.tick_pixel(F.col("tick"), factor).alias("t")).agg(F.sum(F.col("adc").cast("double")).alias("adc"))


def cut(pixels: DataFrame, cutoff: float = P.CUTOFF, saturation: float = P.SATURATION) -> DataFrame:
    return pixels.withColumn("adc", P.apply_cuts(F.col("adc"), cutoff, saturation))


def catalog(pixels: DataFrame, size: tuple[int, int], keys: Iterable[str] = ("event_id",), shape: tuple[int, int] = (P.WIRES, P.TICKS), every: bool = False) -> DataFrame:
    """keys, tile_index, charge, occupancy of cut pixels. every: tiles without a pixel too, for each key that occurs."""
    sw, st = size
    index = P.tile_index(F.col("wire"), F.col("t"), sw, st, shape[1]).alias("tile_index")
    found = pixels.groupBy(*keys, index).agg(F.sum("adc").alias("charge"), F.count_if(F.col("adc") != 0).alias("occupancy"))
    if not every:
        return found
    n = tiles_per_event(size, shape)
    grid = pixels.select(*keys).distinct().withColumn("tile_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return grid.join(found, [*keys, "tile_index"], "left").na.fill(0, ["charge", "occupancy"])


def catalog_sizes(pixels: DataFrame, sizes: Iterable[tuple[int, int]] = P.TILE_SIZES, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """size (like 18x16), keys, tile_index, charge, occupancy: catalog() of several sizes in one pass."""
    each = F.array(*(F.struct(F.lit(f"{w}x{t}").alias("size"), P.tile_index(F.col("wire"), F.col("t"), w, t).alias("tile_index")) for w, t in sizes))
    rows = pixels.withColumn("_s", F.explode(each))
    return rows.groupBy(F.col("_s.size").alias("size"), *keys, F.col("_s.tile_index").alias("tile_index")).agg(F.sum("adc").alias("charge"), F.count_if(F.col("adc") != 0).alias("occupancy"))


def kept_shares(tiles: DataFrame, events: DataFrame, sizes: Iterable[tuple[int, int]] = P.TILE_SIZES, charge_min: float = 50, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """size, kept, total, kept_fraction: of all tiles of all events; tiles: from catalog_sizes()."""
    n = F.broadcast(events.select(*keys).distinct().agg(F.count("*").alias("_n")))  # one row
    every = F.create_map(*(x for w, t in sizes for x in (F.lit(f"{w}x{t}"), F.lit(tiles_per_event((w, t))).cast("long"))))
    kept = keep(tiles, charge_min).groupBy("size").agg(F.count("*").alias("kept"))
    rows = tiles.select("size").distinct().join(kept, "size", "left").join(n, F.col("_n") > 0)
    rows = rows.select("size", F.coalesce("kept", F.lit(0)).alias("kept"), (F.element_at(every, F.col("size")) * F.col("_n")).alias("total"))
    return rows.withColumn("kept_fraction", F.col("kept") / F.col("total"))


def keep(tiles: DataFrame, charge_min: float = 50) -> DataFrame:
    """Tiles of charge_min or more; with 0, those with any charge."""
    return tiles.filter(F.col("charge") >= charge_min if charge_min > 0 else F.col("charge") > 0)


def tiles_per_event(size: tuple[int, int], shape: tuple[int, int] = (P.WIRES, P.TICKS)) -> int:
    return (shape[0] // size[0]) * (shape[1] // size[1])


def count_tiles(events: DataFrame, size: tuple[int, int], keys: Iterable[str] = ("event_id",), only: Iterable[int] | None = None) -> DataFrame:
    """One row, total: tiles of all events, or of those in `only` (by the last key), the empty ones included."""
    keys = list(keys)
    rows = events if only is None else events.filter(F.col(keys[-1]).isin(list(only)))
    return rows.select(*keys).distinct().agg((F.count("*") * tiles_per_event(size)).alias("total"))


def threshold_scan(tiles: DataFrame, thresholds: Iterable[float], size: tuple[int, int] | None = None, keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """threshold, kept, total, fraction of the rows of tiles; with the tiles' size, of all tiles of the events that occur:
    the empty ones, which have no row, count with charge 0."""
    each = sorted(set(map(float, thresholds)))
    per = tiles.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.col("charge") >= x).alias(f"k{i}") for i, x in enumerate(each)))
    if size:
        empty = tiles_per_event(size) - F.col("n")
        per = per.withColumns({f"k{i}": F.col(f"k{i}") + empty for i, x in enumerate(each) if x <= 0} | {"n": F.lit(tiles_per_event(size)).cast("long")})
    row = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *(f"k{i}" for i in range(len(each))))))
    out = row.select("n", F.explode(F.array(*(F.struct(F.lit(x).alias("threshold"), F.col(f"k{i}").alias("kept")) for i, x in enumerate(each)))).alias("r"))
    return out.select("r.threshold", "r.kept", F.col("n").alias("total"), F.when(F.col("n") > 0, F.col("r.kept") / F.col("n")).otherwise(0.0).alias("fraction"))


def with_pixels_of(pixels: DataFrame, kept: DataFrame, size: tuple[int, int], keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """Only the pixels of kept tiles: the small catalogue prunes the images."""
    rows = pixels.withColumn("tile_index", P.tile_index(F.col("wire"), F.col("t"), *size))
    return rows.join(kept.select(*keys, "tile_index"), [*keys, "tile_index"], "left_semi")


def dense(pixels: DataFrame, size: tuple[int, int], keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """keys, tile_index, px: array of sw * st values, time fastest; places without a pixel are 0, rows of one place are added
    up. Pixels are put in order once and the gaps between neighbours filled, so that a tile costs what it holds."""
    sw, st = size
    place = ((F.col("wire") % sw) * st + F.col("t") % st).cast("int")
    points = pixels.groupBy(*keys, P.tile_index(F.col("wire"), F.col("t"), sw, st).alias("tile_index"), place.alias("k")).agg(F.sum("adc").cast("float").alias("v"))
    rows = points.groupBy(*keys, "tile_index").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("e"))  # sw * st at most
    gap = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    before = lambda i: F.coalesce(F.get("e", i - 1)["k"], F.lit(-1))
    parts = F.transform("e", lambda x, i: F.concat(gap(x["k"] - before(i) - 1), F.array(x["v"])))
    return rows.select(*keys, "tile_index", F.concat(F.flatten(parts), gap(F.lit(sw * st - 1) - F.element_at("e", -1)["k"])).alias("px"))


def order_check(pixels: DataFrame, size: tuple[int, int], keys: Iterable[str] = ("event_id",), shape: tuple[int, int] = (P.WIRES, P.TICKS), rtol: float = 1e-4) -> DataFrame:
    """keys, tile_index, charge of catalog(), with an error on the first tile whose charge another numbering doesn't give: that of
    the image cut into strips of wires, and those into ticks, one after another."""
    keys, (sw, st) = list(keys), size
    cuts = lambda n, step: F.sequence(F.lit(0).cast("long"), F.lit(n - step).cast("long"), F.lit(step).cast("long"))
    starts = pixels.sparkSession.range(1).select(F.explode(F.flatten(F.transform(cuts(shape[0], sw), lambda w: F.transform(cuts(shape[1], st), lambda t: F.struct(w.alias("_w"), t.alias("_t")))))).alias("s"))
    numbered = pixels.sparkSession.createDataFrame([(r["s"]["_w"], r["s"]["_t"], k) for k, r in enumerate(starts.collect())], "_w long, _t long, tile_index long")  # the tiles of one image
    rows = pixels.withColumn("_w", (F.col("wire") - F.col("wire") % sw).cast("long")).withColumn("_t", (F.col("t") - F.col("t") % st).cast("long"))
    other = rows.join(F.broadcast(numbered), ["_w", "_t"], "left").groupBy(*keys, "tile_index").agg(F.sum("adc").alias("_other"))
    mine = catalog(pixels, size, keys, shape).select(*keys, "tile_index", "charge")
    both = mine.join(other, [*keys, "tile_index"], "full_outer")
    close = F.abs(F.col("charge") - F.col("_other")) <= F.lit(rtol) * F.abs("_other") + 1e-8
    wrong = F.raise_error(F.concat(F.lit(f"the order of {sw}x{st} tiles differs at tile "), F.coalesce(F.col("tile_index").cast("string"), F.lit("?"))))
    return both.select(*keys, "tile_index", F.when(F.coalesce(close, F.lit(False)), F.col("charge")).otherwise(wrong.cast("double")).alias("charge"))


def lit_only(images: DataFrame, px: str = "px") -> DataFrame:
    """Images that aren't all zero."""
    return images.filter(F.exists(px, lambda x: x != 0))


def where(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition in SQL, made at run time, holds."""
    return df.filter(condition)


def packed(pixels: DataFrame, key: str = "row", width: str = "crop_w", height: str = "crop_h") -> DataFrame:
    """key, width, height, px: each key's pixels (x, y, adc within its own box) as one flat array, y fastest; ragged."""
    place = (F.col("x") * F.col(height) + F.col("y")).cast("int")
    points = pixels.groupBy(key, width, height, place.alias("k")).agg(F.sum("adc").cast("float").alias("v"))
    rows = points.groupBy(key, width, height).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("e"))  # of one crop
    gap = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    before = lambda i: F.coalesce(F.get("e", i - 1)["k"], F.lit(-1))
    parts = F.transform("e", lambda x, i: F.concat(gap(x["k"] - before(i) - 1), F.array(x["v"])))
    tail = gap((F.col(width) * F.col(height) - 1 - F.element_at("e", -1)["k"]).cast("int"))
    return rows.select(key, width, height, F.concat(F.flatten(parts), tail).alias("px"))


def unpacked(images: DataFrame, key: str = "row", height: str = "crop_h") -> DataFrame:
    """The inverse of packed(): key, x, y, adc of what isn't 0."""
    rows = images.select(key, height, F.posexplode("px").alias("k", "v")).filter("v <> 0")
    return rows.select(key, F.floor(F.col("k") / F.col(height)).alias("x"), (F.col("k") % F.col(height)).cast("long").alias("y"), F.col("v").cast("double").alias("adc"))


def offsets(images: DataFrame, key: str = "row", px: str = "px") -> DataFrame:
    """key, start, stop: where each image lies if all were laid end to end in the order of the key (distinct)."""
    sizes = images.select(key, F.size(px).cast("long").alias("n"))
    return running(sizes, [F.col(key)], {"stop": "n"}).select(key, (F.col("stop") - F.col("n")).alias("start"), "stop")


def image(images: DataFrame, number: int, key: str = "row") -> DataFrame:
    """The one image of this number with its metadata; the filter reaches the scan."""
    return images.filter(F.col(key) == number)


def iterate(images: DataFrame):
    """Rows one after another; a partition at a time is on the driver."""
    return images.toLocalIterator(prefetchPartitions=False)


def montage(images: DataFrame, key: str, columns: int, width: str = "crop_w", height: str = "crop_h", gap: int = 1) -> DataFrame:
    """images with grid_row, grid_col, left, top: cells as large as the largest image, in the order of the key (distinct)."""
    ranked = value_ranks(images, key, "_r").withColumn("_k", F.col("_r").cast("long") - 1)
    w, h = images.agg(F.max(width), F.max(height)).first()
    out = ranked.withColumns({"grid_row": F.floor(F.col("_k") / columns), "grid_col": (F.col("_k") % columns)})
    return out.withColumns({"left": F.col("grid_col") * ((w or 0) + gap), "top": F.col("grid_row") * ((h or 0) + gap)}).drop("_r", "_k")


def restore(tiles: DataFrame, size: tuple[int, int], keys: Iterable[str] = ("event_id",)) -> DataFrame:
    """The inverse of dense(): keys, wire, t, adc of the pixels that aren't 0."""
    sw, st = size
    rows = tiles.select(*keys, "tile_index", F.posexplode("px").alias("k", "v")).filter("v <> 0")
    wire = P.tile_row(F.col("tile_index"), st) * sw + F.floor(F.col("k") / st)
    t = P.tile_col(F.col("tile_index"), st) * st + F.col("k") % st
    return rows.select(*keys, wire.alias("wire"), t.cast("long").alias("t"), F.col("v").cast("double").alias("adc"))
