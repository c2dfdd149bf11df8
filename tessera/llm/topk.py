"""Exact top-k by inner product, with a pivot table.

Distances from every vector to many pivots are computed once. Distances to several pivots together bound more than each of them
alone: they fix a vector's coordinates in the flat space that the pivots span, and its distance r from that space, so that no
x with coordinates z and r is nearer to a query q than sqrt(|z_q - z_x|^2 + (r_q - r_x)^2), the largest of the lower bounds
that any choice of the pivots gives. The inner product is then z_q.z_x + r_q r_x at most. The table keeps z and r.

A query starts with the k-th best of a sample of the rows as its score to beat. In every block of rows, the candidates of the
highest bounds are evaluated first; then all others whose bounds aren't strictly below the k-th best score so far, and the rest
can't matter: no result is lost. Every task keeps k rows a query, which a shuffle by query merges.

Queries go to the tasks in waves of about `wave` vectors: the driver holds one wave at a time, and each is one pass
over the stored table, whose rows are written before the next wave is read.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part. Vectors of
different lengths count as zero beyond their end. An id that occurs more than once is a candidate by each row, and
a query once (with the smallest of its vectors). Components are whole numbers that float64 holds, of any size: products are exact
(`whole`). Scores beyond 64 bits are held at the largest or smallest number, after ranking. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import whole
from tessera.llm.common import sampled, stored
from tessera.llm.whole import SCORE, as_columns, best, dense, norms
from tessera.sources.storage import stored_in_turn

#: Rows of the sample from which pivots are chosen and first scores to beat are taken; rows that are evaluated together.
POOL, BLOCK = 4000, 2048


def whole_numbers(embedding: Column, scale: int = 1024) -> Column:
    return whole.whole_numbers(embedding, scale)


def sample_of(vectors: DataFrame, pool: int = POOL, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a hash sample of about `pool` rows."""
    total = max(1, vectors.count())
    rows = vectors.filter(sampled(F.col("vec_id"), min(1.0, pool / total), seed)).orderBy("vec_id", "v").limit(2 * pool).select("vec_id", "v").toArrow()
    return rows.column("vec_id").to_numpy(), dense(rows.column("v"))


class Pivots:
    """A basis of the space that chosen vectors of a sample span: each is the farthest from the span of those before.

    size: all is divided by it for a while, so that squares of large components stay finite."""

    def __init__(self, x: np.ndarray, n: int):
        self.size = float(np.abs(x).max(initial=0.0)) or 1.0
        self.width = x.shape[1]
        x = x / self.size
        self.first = x[0] if len(x) else np.zeros(self.width)
        left, basis = x - self.first, []
        for _ in range(min(n - 1, self.width)):
            far = (left * left).sum(axis=1)
            if not len(far) or far.max() < 1e-12:
                break
            e = left[far.argmax()]
            for _ in range(2):  # twice, for rounding
                for b in basis:
                    e = e - (e @ b) * b
            if (length := np.sqrt(e @ e)) < 1e-7:
                break
            basis.append(e / length)
            left = left - (left @ basis[-1])[:, None] * basis[-1]
        self.basis = np.array(basis).reshape(len(basis), self.width)

    def table(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of the rows, and last their distance from the space. Components beyond the width count to the distance."""
        with np.errstate(over="ignore"):
            x = x / self.size
            more = norms(x[:, self.width :]) if x.shape[1] > self.width else np.zeros(len(x))
            own = np.pad(x[:, : self.width], ((0, 0), (0, max(0, self.width - x.shape[1]))))
            z = own @ self.basis.T
            return np.column_stack([z, np.hypot(norms(own - z @ self.basis), more)]) * self.size

    def bounds(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of the rows of two tables, and a little more: they must never be too small."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = q @ x.T + 1e-9 * norms(q)[:, None] * norms(x)[None, :] + 1e-6
        return np.where(np.isnan(out), np.inf, np.maximum(out, -1.7e308))  # what is below float64's range is below this


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, n_pivots: int = 56, wave: int = 8192, evaluated: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest scores; vectors, queries: vec_id, v (whole numbers).

    evaluated: counts the products that were taken.
    """
    spark = vectors.sparkSession
    exact = F.transform("v", lambda x: F.when((x.cast("double").cast("long") == x) & (x < (1 << 63) - 1), x.cast("double")).otherwise(F.raise_error(F.lit("float64 doesn't hold a component")).cast("double")))
    held = lambda df: df.select("vec_id", F.col("v").cast("array<double>") if dict(df.dtypes)["v"] == "array<double>" else exact.alias("v")).dropna()
    vectors, queries = stored(held(vectors)), held(queries)
    own_ids, own_rows = sample_of(vectors)
    pivots = Pivots(own_rows, n_pivots)

    def measured(batches):
        for batch in batches:
            table = pivots.table(dense(batch.column("v")))
            n = table.shape[1]
            d = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * n), pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), d], ["vec_id", "v", "d"])

    ready = stored(vectors.mapInArrow(measured, "vec_id long, v array<double>, d array<double>"))
    asked = stored(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    waves = -(-asked.count() // wave)

    def turns():
        for w in range(waves):
            own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).orderBy("vec_id").toArrow()  # about `wave` rows
            ids, q = own.column("vec_id").to_numpy(), dense(own.column("v"))
            now = spark.sparkContext.broadcast((ids, q, to_beat(ids, q, own_ids, own_rows, k)))
            yield ready.mapInArrow(scan(now, pivots, k, evaluated), f"query_id long, vec_id long, {SCORE}")
            now.destroy()

    out = stored_in_turn(turns())
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def to_beat(ids: np.ndarray, q: np.ndarray, own_ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """By query, the k-th best score of the sample's other rows, or a little less; minus infinity if it has fewer."""
    out = np.full(len(ids), -np.inf)
    for a in range(0, len(ids) if len(rows) > k else 0, 256):
        x, y = whole.same_width(q[a : a + 256], rows)
        with np.errstate(over="ignore", invalid="ignore"):
            s = x @ y.T
            s[~np.isfinite(s) | (own_ids == ids[a : a + 256, None])] = -np.inf
            least = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k]
            out[a : a + 256] = least - 1e-9 * norms(x) * norms(y).max(initial=0.0)
    return np.where(np.isnan(out), -np.inf, out)


def scan(now, pivots: Pivots, k: int, evaluated: Accumulator | None):
    """A task's k best rows for each query; now: ids and vectors of the queries and their scores to beat."""

    def run(batches):
        ids, q, beat = now.value
        beat = beat.copy()
        table = pivots.table(q)
        found: list[tuple[list, list]] = [([], []) for _ in ids]  # scores and rows of each query, best first

        def take(j: int, scores, keys) -> None:
            s = list(scores) + found[j][0]
            i = np.array([*keys, *found[j][1]], np.int64)
            kind = np.array(s, object if any(isinstance(v, int) for v in s) else float)
            top = best(kind, i, k)
            found[j] = [s[t] for t in top], i[top].tolist()
            if len(top) == k:
                beat[j] = max(beat[j], lowered(found[j][0][-1]))

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                key, x, d = rows.column("vec_id").to_numpy(), dense(rows.column("v")), dense(rows.column("d"))
                for a in range(0, len(ids), BLOCK):
                    part = slice(a, a + BLOCK)
                    high = pivots.bounds(table[part], d)
                    high[key[None, :] == ids[part, None]] = -np.inf
                    able = high >= beat[part, None]
                    # first those of the highest bounds; what they leave, if its bounds allow, afterwards
                    early = np.zeros_like(able)
                    if high.shape[1] > 4 * k:
                        np.put_along_axis(early, np.argpartition(-high, 4 * k, axis=1)[:, : 4 * k], True, axis=1)
                    else:
                        early[:] = True
                    for turn in (able & early, able & ~early):
                        j, i = np.nonzero(turn & (high >= beat[part, None]) & (high > -np.inf))
                        for p in range(0, len(j), 1 << 16):
                            weigh(j[p : p + (1 << 16)] + a, i[p : p + (1 << 16)], q, x, key, take)
                        if evaluated is not None:
                            evaluated.add(len(j))
        who = [j for j in range(len(ids)) for _ in found[j][1]]
        values = [int(v) for s, _ in found for v in s]
        yield pa.RecordBatch.from_arrays([pa.array(ids[who] if who else [], pa.int64()), pa.array([i for _, r in found for i in r], pa.int64()), *as_columns(values)], ["query_id", "vec_id", "score", "beyond"])

    return run


def lowered(score) -> float:
    """A float64 that isn't over the score."""
    try:
        value = float(score)
    except OverflowError:
        return -np.inf if score < 0 else 1.7e308
    return value if int(value) <= score else float(np.nextafter(value, -np.inf))


def weigh(j: np.ndarray, i: np.ndarray, q: np.ndarray, x: np.ndarray, key: np.ndarray, take) -> None:
    """Exact products of pairs of queries j (in order) and rows i, given to take() by query."""
    a, b = whole.same_width(q, x)
    with np.errstate(over="ignore", invalid="ignore"):
        large = norms(a[j]) * norms(b[i]) >= 2.0**52
        s = np.einsum("pd,pd->p", a[j], b[i])
    cuts = np.flatnonzero(np.diff(j, prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(j)), strict=True):
        scores = s[low:high].tolist()
        for p in np.flatnonzero(large[low:high]).tolist():
            scores[p] = sum(map(int.__mul__, map(int, a[j[low]].tolist()), map(int, b[i[low + p]].tolist())))
        take(int(j[low]), scores, key[i[low:high]].tolist())
