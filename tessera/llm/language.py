"""Language identification by nearest centroid.

Letters 1-, 2- and 3-grams are hashed into `DIM` counts; square-rooted, weighted by inverse document
frequency (over every training document) and normalised. Spherical k-means gives several centroids for
each language; a text gets the language of the centroid of highest cosine. It is rejected when that
cosine is under half the first percentile seen in training for texts of about its length.

Null texts and texts without a letter are `und`, score 0, rejected. Ids are not read: rows with a null or repeated id are
rows like any others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_size, map_rows, release, sampled, with_columns

DIM = 4096
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts (rows by DIM) and the number of letters of each text. Other characters are gaps."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low])
    code = np.frombuffer("".join(t + "  " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    code = np.where(is_letter, code, np.uint32(32))
    one, two, three = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)
    a, b, c = code[:-2], code[1:-1], code[2:]
    shift = np.uint32(32 - 12)
    single = (a * one + np.uint32(1)) * two >> shift
    double = ((a * one + b) * two + np.uint32(2)) * three >> shift
    triple = (((a * one + b) * two + c) * three + np.uint32(3)) * one >> shift
    keep1 = is_letter[:-2]
    keep2 = keep1 | is_letter[1:-1]
    keep3 = is_letter[1:-1]
    out, n_letters = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    begin = 0
    for k, size in enumerate(sizes.tolist()):
        s = slice(begin, begin + size)
        n_letters[k] = keep1[s].sum()
        out[k] = np.bincount(np.concatenate((single[s][keep1[s]], double[s][keep2[s]], triple[s][keep3[s]])), minlength=DIM)
        begin += size + 2
    return out, n_letters


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.sqrt(found) * idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


@dataclass
class CentroidModel:
    """centroids: rows, of language langs[k]; limits: least cosine by the log2 of the number of letters."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is too low, by text."""
        names, best, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        full = [t or "" for t in texts]
        for a, b in by_size(full, 1_000_000):
            found, n = counts(full[a:b])
            if len(self.langs):
                cosines = vectors(found, self.idf) @ self.centroids.T
                top = cosines.argmax(axis=1)
                value = np.clip(cosines[np.arange(b - a), top].astype(float), 0, 1)
                for k in np.flatnonzero(n):
                    names[a + k] = self.langs[top[k]]
                    best[a + k] = value[k]
                    far[a + k] = value[k] < self.limits[bucket(n[k])]
        return names, best, far


def bucket(n: int) -> int:
    return min(15, int(n).bit_length())


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Starts from the row nearest to the mean, then each time from the row farthest from the centres so far."""
    centre = [int((x @ x.mean(axis=0)).argmax())]
    for _ in range(1, min(k, len(x))):
        centre.append(int((x @ x[centre].T).max(axis=1).argmin()))
    centroids = x[centre]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        for j in range(len(centroids)):
            if (own == j).any():
                mean = x[own == j].sum(axis=0)
                centroids[j] = mean / max(float(np.sqrt((mean * mean).sum())), 1e-12)
    return centroids


def train(docs: DataFrame, clusters: int = 4, max_docs: int = 500, seed: int = 5) -> CentroidModel:
    """docs: text, lang. Document frequencies are over all of them; centroids come from a hash sample of about `max_docs`
    texts of each language, copies counting once. Rows with null text or lang are left out. A language's centroids are
    fitted in one task, and come to the driver with the least cosines: some 100 KB a language."""
    known = docs.select("text", "lang").dropna()
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return CentroidModel([], np.zeros((0, DIM), np.float32), np.ones(DIM, np.float32), np.zeros(16))

    def frequencies(batches):
        total = np.zeros(DIM, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in by_size(texts, 1_000_000):
                total += (counts(texts[a:b])[0] > 0).sum(axis=0)
        release()
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["slot", "n"])

    seen = np.zeros(DIM)
    for r in known.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        seen[r["slot"]] = r["n"]
    idf = (np.log((1 + sum(n.values())) / (1 + seen)) + 0.1).astype(np.float32)

    share = F.element_at(F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(max_docs / v))]), F.col("lang"))
    picked = known.filter(sampled(F.col("text"), share, seed)).dropDuplicates()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, rows, held, size = batch.column("text").to_pylist(), [], [], []
            for a, b in by_size(texts):  # long texts by themselves
                found, n = counts(texts[a:b])
                own = [np.flatnonzero(x).astype(np.int32) for x in found]
                rows, held, size = rows + own, held + [x[r].astype(np.int32) for x, r in zip(found, own, strict=True)], size + n.tolist()
            columns = [pa.array(size, pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(held, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([batch.column("lang"), *columns], ["lang", "n", "slots", "counts"])

        return work

    def fitted(group: pa.Table) -> pa.Table:
        rows = sorted((r for r in group.to_pylist() if r["n"]), key=lambda r: (r["n"], r["slots"], r["counts"]))
        x = np.zeros((len(rows), DIM), np.float32)
        for k, r in enumerate(rows):
            x[k, r["slots"]] = r["counts"]
        x = vectors(x, idf)
        c = spherical_kmeans(x, clusters) if rows else x
        near = [{"n": r["n"], "cosine": float(v)} for r, v in zip(rows, (x @ c.T).max(axis=1) if rows else [], strict=True)]
        return pa.table([group.column("lang")[:1], pa.array([[v.tolist() for v in c]], pa.list_(pa.list_(pa.float32()))), pa.array([near], kind)], ["lang", "centroids", "near"])

    kind = pa.list_(pa.struct([("n", pa.int64()), ("cosine", pa.float64())]))
    sample = map_rows(picked, "lang string, n long, slots array<int>, counts array<int>", make, 64)
    rows = sample.groupBy("lang").applyInArrow(fitted, "lang string, centroids array<array<float>>, near array<struct<n:long,cosine:double>>").orderBy("lang").collect()
    near = [[] for _ in range(16)]
    for r in rows:
        for x in r["near"]:
            near[bucket(x["n"])].append(x["cosine"])
    langs = [r["lang"] for r in rows for _ in r["centroids"]]
    centroids = np.array([c for r in rows for c in r["centroids"]], np.float32).reshape(-1, DIM)
    every = [v for x in near for v in x]
    limits = np.array([0.5 * np.quantile(x, 0.01) if len(x) >= 20 else 0.5 * min(every, default=0.0) for x in near])
    return CentroidModel(langs, centroids, idf, np.minimum.accumulate(limits[::-1])[::-1])


def predict(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """docs (with a text column) and lang_pred, score (cosine), rejected."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            names, best, far = model.predict(batch.column("text").to_pylist())
            return [pa.array(names, pa.string()), pa.array(best), pa.array(far)]

        return work

    return with_columns(docs, "lang_pred string, score double, rejected boolean", make)
