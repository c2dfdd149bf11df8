"""Toxic spans and document scores from a linear-chain conditional random field.

Two states, clean and toxic. A token's potential sums hashed weights of the word, of its first 4, 5 and 6
letters, and of its two neighbours; a 2 x 2 table scores moves between states. Token labels for training come
from the labelled documents: in toxic ones, the few words or stems that tell them from the clean ones (greedy cover).
Forward-backward marginals give spans (runs above `span_threshold`) and, through a logistic layer on
their sum and maximum, a document score.

Null and empty texts have no token: they get the score of a document without evidence. Without any labelled row every
score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_size, map_rows, sampled, with_columns

TOKEN = re.compile(r"[^\W\d_]+")
BITS = 18
#: The features of a token: the word, then its stems.
STEMS = (4, 5, 6)
UNITS = 1 + len(STEMS)


def units(token: str) -> list[int]:
    """Hashes of the lower-case word and of its stems; a shorter word has the word's own hash there."""
    word = token.lower()
    whole = zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - BITS)
    return [whole, *(zlib.crc32(f"{n}{word[:n]}".encode("utf-8", "surrogatepass")) >> (32 - BITS) if len(word) > n else whole for n in STEMS)]


class Tokens(dict):
    """Token -> row of `rows`, its units. reset() drops all once there are many."""

    def __init__(self) -> None:
        self.rows: list[list[int]] = []

    def __missing__(self, token: str) -> int:
        self[token] = found = len(self.rows)
        self.rows.append(units(token))
        return found

    def reset(self, most: int = 150_000) -> bool:
        if full := len(self) > most:
            self.clear()
            self.rows.clear()
        return full


@dataclass
class CrfModel:
    """word, before, after: weights by hashed unit; move[i, j]: from state i to j; first: the start."""

    word: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    move: np.ndarray
    first: np.ndarray
    scale: tuple[float, float, float]

    def evidence(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of the toxic state by token; rows: the tokens' units; starts: where documents begin."""
        return chained(self.word[rows].sum(axis=1) + np.float32(self.bias), self.before[rows[:, 0]], self.after[rows[:, 0]], starts)

    def score(self, total: np.ndarray, top: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * top, -35, 35)))


def chained(own: np.ndarray, before: np.ndarray, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each token's own evidence and what its neighbours in the document give."""
    out, n = own.copy(), len(own)
    if n > 1:
        inner = starts[(starts > 0) & (starts < n)]
        left, right = before[:-1].copy(), after[1:].copy()
        left[inner - 1] = 0
        right[inner - 1] = 0
        out[1:] += left
        out[:-1] += right
    return out


def marginals(evidence: np.ndarray, starts: np.ndarray, move: np.ndarray, first: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state by token, and expected moves (2 x 2), for documents laid end to end.

    A document's first step has equal rows, which cuts the chain there. Blocks of the chain are
    multiplied side by side, joined by one short loop, and then run through again.
    """
    n = len(evidence)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    length = max(1, int(n**0.5) // 2)
    width = -(-n // length)
    e = np.zeros(length * width)
    e[:n] = np.exp(np.clip(evidence, -30, 30))
    steps = np.empty((length * width, 2, 2))
    steps[:] = np.exp(move)
    steps[starts[starts < n]] = np.exp(first)
    steps[:, :, 1] *= e[:, None]
    steps[n:] = 0.5
    steps /= steps.max(axis=(1, 2), keepdims=True)
    grid = steps.reshape(width, length, 2, 2).transpose(1, 2, 3, 0).copy()  # step, from, to, block

    product = np.zeros((2, 2, width))
    product[0, 0] = product[1, 1] = 1
    for m in grid:
        product = product[:, :1] * m[0] + product[:, 1:] * m[1]
        product /= product.max(axis=(0, 1)) + 1e-300
    enter, leave = np.empty((2, width)), np.empty((2, width))
    a = (0.5, 0.5)
    rows = product.transpose(2, 0, 1).tolist()
    for k, ((p, q), (r, s)) in enumerate(rows):
        enter[:, k] = a
        x, y = a[0] * p + a[1] * r, a[0] * q + a[1] * s
        a = (x / (x + y), y / (x + y))
    b = (0.5, 0.5)
    for k in range(width - 1, -1, -1):
        (p, q), (r, s) = rows[k]
        leave[:, k] = b
        x, y = p * b[0] + q * b[1], r * b[0] + s * b[1]
        b = (x / (x + y), y / (x + y))

    forward, backward = np.empty((length, 2, width)), np.empty((length, 2, width))
    now = enter
    for k, m in enumerate(grid):
        now = now[0] * m[0] + now[1] * m[1]
        now /= now[0] + now[1]
        forward[k] = now
    now = leave
    for k in range(length - 1, -1, -1):
        backward[k] = now
        now = grid[k][:, 0] * now[0] + grid[k][:, 1] * now[1]
        now /= now[0] + now[1]
    both = forward * backward
    toxic = (both[:, 1] / (both[:, 0] + both[:, 1])).T.ravel()[:n]
    if not pairs:
        return toxic, np.zeros((2, 2))
    past = forward.transpose(2, 0, 1).reshape(-1, 2)[: n - 1]
    future = backward.transpose(2, 0, 1).reshape(-1, 2)[1:n]
    pair = past[:, :, None] * steps[1:n] * future[:, None, :]
    inside = np.ones(n - 1, bool)
    inside[starts[(starts > 0) & (starts < n)] - 1] = False
    pair = pair[inside] / (pair[inside].sum(axis=(1, 2), keepdims=True) + 1e-300)
    return toxic, pair.sum(axis=0)


def telling_units(docs: list[np.ndarray], toxic: np.ndarray, cover: int = 6, least_docs: float = 2, least_share: float = 0.005, least_odds: float = 3.0) -> np.ndarray:
    """Mask of the units that mark toxic documents: greedily, the one that most of them still lack, until each has
    `cover` marked words or no unit adds enough. Toxic documents that share most of their words (copies) count as one."""
    size = 1 << BITS
    kinds = [np.unique(x, axis=0) for x in docs]
    hits = [np.bincount(np.concatenate([np.unique(x) for x, t in zip(kinds, toxic, strict=True) if t == k] or [np.zeros(0, int)]), minlength=size) for k in (0, 1)]
    n = np.bincount(toxic, minlength=2)
    able = (np.log((hits[1] + 0.5) / (n[1] + 1)) - np.log((hits[0] + 0.5) / (n[0] + 1)) > least_odds) & (hits[1] >= least_docs)
    chosen = np.zeros(size, bool)
    rows = [(x, x[able[x].any(axis=1)]) for x, t in zip(kinds, toxic, strict=True) if t]
    rows = [(x, marked) for x, marked in rows if len(marked)]
    if not rows:
        return chosen
    words = np.zeros((len(rows), 4096), np.float32)
    for k, (x, _) in enumerate(rows):
        words[k, x[:, 0] & 4095] = 1
    words /= np.sqrt(words.sum(axis=1, keepdims=True))
    weight = 1 / (words @ words.T > 0.8).sum(axis=1)
    if weight.sum() < len(rows) / 5:  # so few different words that texts can't be told from copies
        weight = np.ones(len(rows))
    rows = [marked for _, marked in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    flat, need = np.concatenate(rows), np.full(len(rows), cover)
    least = max(least_docs, least_share * weight.sum())
    while len(flat):
        pairs = np.unique((doc[:, None] * size + flat)[able[flat]])
        gain = np.bincount(pairs % size, weight[pairs // size], size)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen[best] = True
        hit = (flat == best).any(axis=1)
        need = need - np.bincount(doc[hit], minlength=len(rows))
        left = ~hit & (need[doc] > 0)
        flat, doc = flat[left], doc[left]
    return chosen


def fit(docs: list[np.ndarray], toxic: np.ndarray, share: float, updates: int = 120, rate: float = 0.5, l2: float = 1e-4, seed: int = 7) -> CrfModel:
    """Adagrad on the chain's log likelihood, then a logistic layer. docs: units by token; share: toxic documents
    among all labelled ones."""
    size = 1 << BITS
    model = CrfModel(np.zeros(size, np.float32), np.zeros(size, np.float32), np.zeros(size, np.float32), -2.0, np.zeros((2, 2)), np.zeros((2, 2)), (0.0, 0.0, 0.0))
    marked = telling_units(docs, toxic)
    seen = [np.full(size, 1e-3, np.float32) for _ in range(3)]
    seen_bias, seen_move = 1e-3, np.full((2, 2), 1e-3)
    order = np.random.default_rng(seed)
    filled = np.array([k for k in range(len(docs)) if len(docs[k])], int)
    batches = max(1, min(40, len(filled) // 20))
    for _ in range(-(-updates // batches) if len(filled) else 0):
        for part in np.array_split(order.permutation(filled), batches):
            rows = np.concatenate([docs[k] for k in part])
            sizes = np.array([len(docs[k]) for k in part])
            starts = np.cumsum(sizes) - sizes
            truth = (marked[rows].any(axis=1) & np.repeat(toxic[part] == 1, sizes)).astype(float)
            p, moves = marginals(model.evidence(rows, starts), starts, model.move, model.first)
            miss = (truth - p).astype(np.float32)
            inner = np.ones(len(rows), bool)
            inner[starts] = False
            now, then = truth[1:][inner[1:]].astype(int), truth[:-1][inner[1:]].astype(int)
            wanted = np.bincount(then * 2 + now, minlength=4).reshape(2, 2)
            per = np.float32(len(part))
            word = np.bincount(rows.ravel(), np.repeat(miss, UNITS), size)
            before, after = np.bincount(rows[:-1, 0], miss[1:] * inner[1:], size), np.bincount(rows[1:, 0], miss[:-1] * inner[1:], size)
            for w, g, s, r in zip((model.word, model.before, model.after), (word, before, after), seen, (rate, rate / 8, rate / 8), strict=True):
                g = (g / per - l2 * w).astype(np.float32)
                s += g * g
                w += r * g / np.sqrt(s)
            g = miss.sum() / per
            seen_bias += g * g
            model.bias += rate * g / seen_bias**0.5
            g = (wanted - moves) / per
            seen_move += g * g
            model.move = model.move + rate * g / np.sqrt(seen_move)
    model.scale = calibrate(model, docs, toxic, share)
    return model


def calibrate(model: CrfModel, docs: list[np.ndarray], toxic: np.ndarray, share: float) -> tuple[float, float, float]:
    """Newton steps for the document layer; rows weigh as their class does among all labelled documents."""
    x = np.zeros((len(docs), 3))
    x[:, 0] = 1
    zero = np.zeros(1, int)
    for k, rows in enumerate(docs):
        if len(rows):
            p, _ = marginals(model.evidence(rows, zero), zero, model.move, model.first, pairs=False)
            x[k, 1:] = np.log1p(p.sum()), p.max()
    n = np.bincount(toxic, minlength=2)
    weight = np.where(toxic == 1, share / max(n[1], 1), (1 - share) / max(n[0], 1)) * len(docs)
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (weight * (toxic - p)) - 0.05 * w)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 1000, max_chars: int = 200_000, seed: int = 11) -> CrfModel:
    """Fit on a hash sample of about `max_docs` documents of each class; labels: doc_id, toxic. The sample has none of over
    `max_chars` characters (they are scored like all others), so that what the driver gets is bounded.

    Ids labelled more than once count as toxic if any row says so. Rows with a null id, label or text are left out.
    With no document of a class, every score stays near that of the other class.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, max_docs / max(1, n.get(1, 0))).otherwise(max_docs / max(1, n.get(0, 0)))
    picked = marks.filter(sampled(F.col("doc_id"), share, seed))  # about 2 * max_docs ids
    texts = docs.select("doc_id", "text").dropna().filter(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id").drop("doc_id")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            known = Tokens()
            found = [[u for w in TOKEN.findall(t) for u in known.rows[known[w]]] for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "units"])

        return work

    rows = map_rows(texts.select("toxic", "text"), "toxic int, units array<int>", make, 64).orderBy(F.xxhash64("units"), "toxic").toArrow()
    found = [np.asarray(x.values).astype(int).reshape(-1, UNITS) for x in rows.column("units")]
    toxic = rows.column("toxic").to_numpy().astype(int)
    return fit(found, toxic, n.get(1, 0) / max(1, sum(n.values())))


def score(docs: DataFrame, model: CrfModel, span_threshold: float = 0.5) -> DataFrame:
    """docs (with a text column) and score, and spans: array of (start, end) in code points and the mean marginal."""
    schema = "score double, spans array<struct<start:int,end:int,weight:double>>"

    def make():
        known, have = Tokens(), [np.zeros(0, np.float32)] * 3

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal have
            texts = [t or "" for t in batch.column("text").to_pylist()]
            scores, spans = np.zeros(len(texts)), [[] for _ in texts]
            for a, b in by_size(texts):
                if known.reset():
                    have = [np.zeros(0, np.float32)] * 3
                found = [list(map(known.__getitem__, TOKEN.findall(t))) for t in texts[a:b]]
                if new := known.rows[len(have[0]) :]:
                    new = np.array(new)
                    have = [np.concatenate(x) for x in zip(have, (model.word[new].sum(axis=1) + np.float32(model.bias), model.before[new[:, 0]], model.after[new[:, 0]]), strict=True)]
                sizes = np.array([len(x) for x in found])
                starts = np.cumsum(sizes) - sizes
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
                begin = starts[sizes > 0]
                p, _ = marginals(chained(have[0][flat], have[1][flat], have[2][flat], begin), begin, model.move, model.first, pairs=False)
                total, top = np.zeros(b - a), np.zeros(b - a)
                if len(p):
                    total[sizes > 0] = np.add.reduceat(p, starts[sizes > 0])
                    top[sizes > 0] = np.maximum.reduceat(p, starts[sizes > 0])
                scores[a:b] = model.score(total, top)
                for k in np.flatnonzero(top > span_threshold):
                    spans[a + k] = runs(texts[a + k], p[starts[k] : starts[k] + sizes[k]], span_threshold)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))
            return [pa.array(scores), pa.array(spans, kind)]

        return work

    return with_columns(docs, schema, make)


def runs(text: str, p: np.ndarray, threshold: float) -> list[dict]:
    """Neighbouring tokens above the threshold, as offsets into text."""
    out, open_ = [], None
    for m, v in zip(TOKEN.finditer(text), p.tolist(), strict=True):
        if v > threshold:
            if open_ is None:
                open_ = [m.start(), m.end(), []]
            open_[1] = m.end()
            open_[2].append(v)
        elif open_ is not None:
            out.append({"start": open_[0], "end": open_[1], "weight": sum(open_[2]) / len(open_[2])})
            open_ = None
    if open_ is not None:
        out.append({"start": open_[0], "end": open_[1], "weight": sum(open_[2]) / len(open_[2])})
    return out
