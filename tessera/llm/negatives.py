"""Hard negatives from inverted lists.

K-means on a bounded sample gives centroids; every row goes into the list of its nearest one, and lists keep the radius,
the largest distance from the centroid. By Cauchy-Schwarz an anchor a and any x of a list with centroid c and radius r
have a.c - |a| r <= a.x <= a.c + |a| r.

An anchor visits lists in the order of their upper bounds. Positives: lists of its label (with a radius of their own), until
an upper bound falls strictly below the fifth best score. Negatives: lists whose bounds meet the window of scores of
one of its positives, until the upper bound falls strictly below the third best score within that window. Visits come in two
rounds: the first lists of the order settle the scores to beat, then all lists that they don't rule out. Lists and
visits meet in blocks of at most about `BLOCK` rows and `VISITS` anchors, so that no list, label or anchor is one group.

Vectors that are null, or hold null or non-finite components, and rows without id or label take no part. Vectors of different
lengths count as zero beyond their end. An id that occurs more than once is a candidate by each row and an anchor once (with
the smallest of its labels, then of its vectors). Products are exact whole numbers of any size (`whole`); scores are held at the ends of
64 bits at the very end. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import sampled, stored
from tessera.llm.whole import SCORE, as_columns, best, dense, from_columns, norms, products, same_width

BLOCK, VISITS = 4096, 1024
#: Lists: the square root of the number of rows over this, MOST_LISTS at most.
SPREAD, MOST_LISTS = 4, 2048
#: The share of the lists that an anchor visits first.
FIRST = 1 / 8


def centroids(rows: DataFrame, n: int, total: int, each: int = 64, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """n centroids by Lloyd's rounds over a hash sample of about n * each rows."""
    share = min(1.0, n * each / max(total, 1))
    taken = rows.filter(sampled(F.col("u"), share, seed)).orderBy("vec_id", "u").limit(2 * n * each).select("v").toArrow()
    x = dense(taken.column("v"))
    if not len(x):
        x = dense(rows.orderBy("vec_id", "u").limit(n).select("v").toArrow().column("v"))
    size = np.abs(x).max(initial=1.0)
    x = x / size  # so that squares of large components stay finite
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        sums, count = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c * size


def listed(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """rows with list (the nearest centroid) and far (the distance from it)."""

    def nearest(batches):
        for batch in batches:
            x, own = same_width(dense(batch.column("v")), c)
            size = max(np.abs(x).max(initial=1.0), np.abs(own).max(initial=1.0))
            near = (((own / size) ** 2).sum(axis=1) - 2 * (x / size) @ (own / size).T).argmin(axis=1)
            # a little more, for rounding: a radius must never be too small
            far = norms(x - own[near]) * (1 + 1e-12) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], [*batch.schema.names, "list", "far"])

    return rows.mapInArrow(nearest, "vec_id long, label int, v array<double>, u long, list int, far double")


def bounds(a: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of anchors (rows) with the rows of lists (columns)."""
    a, c = same_width(a, c)
    with np.errstate(over="ignore", invalid="ignore"):
        reach, size = norms(a)[:, None] * radius, norms(a)[:, None] * norms(c)
        middle, slack = a @ c.T, 1e-9 * (reach + size) + 1e-6
        low, high = middle - reach - slack, middle + reach + slack
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def met(visits: DataFrame, rows: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(some visits, some rows) for all that have the same keys, in blocks."""
    parts = lambda df, most, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias(name))
    sizes = stored(parts(visits, VISITS, "_nv").join(parts(rows, BLOCK, "_nr"), keys))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = visits.join(sizes, keys).withColumn("_v", F.pmod(F.xxhash64("anchor_id"), F.col("_nv"))).withColumn("_r", each("_nr")).drop("_nv", "_nr")
    right = rows.join(sizes, keys).withColumn("_r", F.pmod(F.xxhash64("u"), F.col("_nr"))).withColumn("_v", each("_nv")).drop("_nv", "_nr")
    by = [*keys, "_v", "_r"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(work, schema)


def first_by(df: DataFrame, by: list[str], k: int, key: str) -> DataFrame:
    """The k best scores of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("beyond"), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, c: np.ndarray, k: int) -> DataFrame:
    """anchor_id, rank, positive_id, score, beyond: the k best other rows of the anchor's label."""
    own = rows.groupBy("label", "list").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    own = stored(own.groupBy("label").agg(F.collect_list(F.struct("list", "radius", "n")).alias("lists")))  # MOST_LISTS at most

    def visit(batches):
        for batch in batches:
            a, lists = dense(batch.column("v")), batch.column("lists").to_pylist()
            row, found, upper, turn = [], [], [], []
            for j, ones in enumerate(lists):
                at, radius = np.array([x["list"] for x in ones]), np.array([x["radius"] for x in ones])
                high = bounds(a[j : j + 1], c[at], radius)[1][0]
                order = np.lexsort((at, -high))
                before = np.cumsum([0, *(ones[i]["n"] for i in order[:-1])])
                row += [j] * len(at)
                found += at[order].tolist()
                upper += high[order].tolist()
                turn += np.where(before <= k, 1, 2).tolist()  # the first hold k rows besides the anchor
            kept = batch.select(["anchor_id", "label", "v"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.int32()), pa.array(upper, pa.float64()), pa.array(turn, pa.int32())], ["anchor_id", "label", "v", "list", "upper", "turn"])

    visits = stored(anchors.join(own, "label").mapInArrow(visit, "anchor_id long, label int, v array<double>, list int, upper double, turn int"))

    def look(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, who = held.column("vec_id").to_numpy(), asked.column("anchor_id").to_pylist()
        s = products(dense(asked.column("v")), dense(held.column("v"))) if len(ids) and len(who) else np.zeros((0, 0))
        a, b, v = [], [], []
        for j in range(len(s)):
            other = np.flatnonzero(ids != who[j])
            top = other[best(s[j, other], ids[other], k)]
            a += [who[j]] * len(top)
            b += ids[top].tolist()
            v += map(int, s[j, top])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *as_columns(v)], ["anchor_id", "positive_id", "score", "beyond"])

    ask = lambda some: first_by(met(some, rows, ["label", "list"], look, f"anchor_id long, positive_id long, {SCORE}"), ["anchor_id"], k, "positive_id")
    first = stored(ask(visits.filter("turn = 1").select("anchor_id", "label", "v", "list")))
    least = first.filter(F.col("rank") == k).select("anchor_id", F.col("score").cast("double").alias("least"), "beyond")
    beaten = (F.col("beyond") == F.lit(b"")) & (F.col("upper") < F.col("least"))  # scores past 64 bits rule nothing out
    more = visits.filter("turn = 2").join(least, "anchor_id", "left").filter(~F.coalesce(beaten, F.lit(False)))
    second = ask(more.select("anchor_id", "label", "v", "list"))
    return first_by(first.drop("rank").union(second.drop("rank")), ["anchor_id"], k, "positive_id")


def mine(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; vectors: vec_id, label, v (whole numbers).

    Anchors are the rows whose id `every` divides. Negatives of a positive have a different label and a score n with
    low * p <= 100 * n <= high * p.
    """
    spark = vectors.sparkSession
    sound = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col("v").cast("array<double>").alias("v")).dropna()
    plain = stored(sound.withColumn("u", F.monotonically_increasing_id()))
    total = plain.count()
    if not total:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    c = centroids(plain, min(MOST_LISTS, max(1, round(total**0.5 / SPREAD))), total)
    rows = stored(listed(plain, c))
    anchors = stored(rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a")).select("anchor_id", "a.label", "a.v"))
    pairs = stored(positives(rows, anchors, c, n_positives))
    told = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score", "beyond"))).alias("pos"))  # n_positives at most
    asked = stored(anchors.join(told, "anchor_id"))
    radius = {r["list"]: r["radius"] for r in rows.groupBy("list").agg(F.max("far").alias("radius")).collect()}  # MOST_LISTS at most
    used = np.array(sorted(radius), np.int64)
    centres, reach = c[used], np.array([radius[k] for k in used.tolist()])

    def windows(batch: pa.RecordBatch | pa.Table) -> list[list[tuple[int, int, int]]]:
        """By anchor, the rank and the least and largest score of each of its positives' windows."""
        scores = [[(p["rank"], from_columns(p["score"], p["beyond"])) for p in pos] for pos in batch.column("pos").to_pylist()]
        return [[(r, -(-low * s // 100), high * s // 100) for r, s in own] for own in scores]

    def visit(batches):
        for batch in batches:
            under, over = bounds(dense(batch.column("v")), centres, reach)
            row, found, upper, rank, turn = [], [], [], [], []
            for j, own in enumerate(windows(batch)):
                order = np.lexsort((used, -over[j]))
                early = np.zeros(len(used), bool)
                early[order[: max(1, int(len(used) * FIRST))]] = True
                for r, a, b in own:
                    meets = np.flatnonzero((over[j] >= float(a)) & (under[j] <= float(b))) if a <= b else []
                    row += [j] * len(meets)
                    found += used[meets].tolist()
                    upper += over[j][meets].tolist()
                    rank += [r] * len(meets)
                    turn += np.where(early[meets], 1, 2).tolist()
            columns = [batch.column("anchor_id").take(pa.array(row, pa.int64())), pa.array(found, pa.int32()), pa.array(upper, pa.float64()), pa.array(rank, pa.int32()), pa.array(turn, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor_id", "list", "upper", "pos_rank", "turn"])

    visits = stored(asked.mapInArrow(visit, "anchor_id long, list int, upper double, pos_rank int, turn int"))

    def look(some: pa.Table, held: pa.Table) -> pa.Table:
        ids, labels = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
        who, own, ranks = some.column("anchor_id").to_pylist(), some.column("label").to_pylist(), some.column("ranks").to_pylist()
        s = products(dense(some.column("v")), dense(held.column("v"))) if len(ids) and len(who) else np.zeros((0, 0))
        a, p, b, v = [], [], [], []
        for j, wanted in enumerate(windows(some)[: len(s)]):
            for r, least, most in wanted:
                if r not in ranks[j] or least > most:
                    continue
                able = np.flatnonzero((labels != own[j]) & (s[j] >= least) & (s[j] <= most))
                top = able[best(s[j, able], ids[able], n_negatives)] if len(able) else able
                a += [who[j]] * len(top)
                p += [r] * len(top)
                b += ids[top].tolist()
                v += map(int, s[j, top])
        return pa.table([pa.array(a, pa.int64()), pa.array(p, pa.int32()), pa.array(b, pa.int64()), *as_columns(v)], ["anchor_id", "pos_rank", "negative_id", "score", "beyond"])

    def ask(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("anchor_id", "list").agg(F.collect_list("pos_rank").alias("ranks")).join(asked, "anchor_id")
        found = met(wanted, rows, ["list"], look, f"anchor_id long, pos_rank int, negative_id long, {SCORE}")
        return first_by(found, ["anchor_id", "pos_rank"], n_negatives, "negative_id")

    first = stored(ask(visits.filter("turn = 1")))
    least = first.filter(F.col("rank") == n_negatives).select("anchor_id", "pos_rank", F.col("score").cast("double").alias("least"), "beyond")
    beaten = (F.col("beyond") == F.lit(b"")) & (F.col("upper") < F.col("least"))
    second = ask(visits.filter("turn = 2").join(least, ["anchor_id", "pos_rank"], "left").filter(~F.coalesce(beaten, F.lit(False))))
    found = first_by(first.drop("rank").union(second.drop("rank")), ["anchor_id", "pos_rank"], n_negatives, "negative_id")
    of = pairs.select("anchor_id", F.col("rank").alias("pos_rank"), "positive_id", F.col("score").alias("positive_score"))
    return found.join(of, ["anchor_id", "pos_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
