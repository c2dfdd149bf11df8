"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Words are slots: frequent ones their own, the others hash buckets, a sixteenth of the slots. There are 1,024, 4,096 or
16,384 slots, by the size of the vocabulary, dealt to 32 or 64 classes.
P(word | history) = P(class | history) P(slot | class, last slot) P(word | slot). The first is a softmax over hashed
features of the history: the last slot, the one before it (a skip), and both together. The second is a softmax over
one: class and last slot together. The third is (c + 1) / (N_b + V_b + 1) from the counts of the words in the bucket,
so that every word, seen or not, has its probability.

Training is gradient ascent from the unigram model. A round broadcasts the weights; every task adds up, over all its
training documents, how often each feature met each class and how often the model expects it (in whole 2^-14, so that
sums don't depend on how rows are dealt); sums meet in two steps, of 256 tasks and of all. A weight then moves by
2 rate (met - expected) / (met + expected + 2 prior p): the gradient by the size of its own curvature, with p
of the unigram model for rare features. The members' gradient needs nothing but counts, so that the first round settles them.

Counts are over all training documents. Words of at least 1 / HOT of the tokens go to the tasks (at most HOT of
them); the others are joined with the table of counts, once for a document and word.

Null and empty texts have one token, the end. Repeated and null ids are rows like any others, each scored by itself.
Long texts are cut at white space into pieces, and slots into chunks, for the work; no token is left out by that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, stored

HOT = 500_000
PIECE = 1 << 21
#: Different words that a task holds before it sends them off.
KINDS = 200_000
TRIGRAMS, MEMBER_ROWS = 1 << 14, 1 << 15
#: Expected counts are whole numbers of 1 / UNIT.
UNIT = 1 << 14
#: Tokens whose histories a task holds before it works out what is expected after them.
HISTORIES = 1 << 21
#: Rows of a table that are added up together.
BLOCK = 64
#: No word is empty.
END = b""
#: Columns of their own; those of the input that have one of these names are replaced.
CODED = ("row", "slots", "n_tokens", "known", "base", "word_log", "rest")
SCORED = ("n_known", "base_score", "score")
WHITE = re.compile(rb"[ \t-\r]")


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, without the end."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(place in texts, words) of pieces of about PIECE bytes at most; a text's last piece has the end."""
    for k, text in enumerate(texts):
        data, at = (text or "").encode("utf-8", "surrogatepass").lower(), 0
        while len(data) - at > PIECE and (cut := WHITE.search(data, at + PIECE)):
            yield k, data[at : cut.start()].split()
            at = cut.start()
        yield k, [*data[at:].split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary; empty for the end), n; over all rows."""

    def rows(found: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches):
        found: Counter[bytes] = Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for _, x in pieces(batch.column("text").slice(start, 64).to_pylist()):
                    found.update(x)
                    if len(found) > KINDS:
                        yield rows(found)
                        found = Counter()
        yield rows(found)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """classes, and members of each; total, kinds: all tokens, distinct ones. Of hot words: place by word, and by place
    count and slot. Other words fall into a bucket's slot."""

    classes: int
    members: int
    total: int
    kinds: int
    place: dict[bytes, int]
    counts: np.ndarray
    slot: np.ndarray
    bucket_log: np.ndarray
    slot_counts: np.ndarray

    @property
    def slots(self) -> int:
        return self.classes * self.members

    @property
    def buckets(self) -> int:
        return self.slots // 16

    @property
    def end(self) -> int:
        return int(self.slot[self.place[END]])

    def bucket(self, word: bytes) -> int:
        return self.slots - self.buckets + zlib.crc32(word) % self.buckets


def shape_for(kinds: int) -> tuple[int, int]:
    """Classes and members by the size of the vocabulary: slots grow with it, up to what tasks can hold."""
    return (32, 32) if kinds < 1 << 18 else (32, 128) if kinds < 1 << 24 else (64, 256)


def vocabulary(counts: DataFrame, shape: tuple[int, int] | None = None) -> Vocabulary:
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = counts.filter((F.col("n") * HOT >= total) | (F.col("word") == F.lit(END))).collect()  # HOT and the end at most
    ranked = sorted(((r["n"], bytes(r["word"])) for r in rows), key=lambda x: (-x[0], x[1]))
    if not any(w == END for _, w in ranked):
        ranked.append((0, END))
    classes, members = shape or shape_for(kinds)
    out = Vocabulary(classes, members, total, kinds, {w: k for k, (_, w) in enumerate(ranked)}, np.array([n for n, _ in ranked], np.int64), np.zeros(len(ranked), np.int64), np.zeros(0), np.zeros(0))
    own = {w for _, w in ranked[: out.slots - out.buckets - 1]} | {END}
    sizes = counts.groupBy((F.crc32("word") % out.buckets).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    held, slot_counts, free = np.zeros((out.buckets, 2)), np.ones(out.slots), 0
    for r in sizes:
        held[r["b"]] = r["n"], r["v"]
    for k, (n, w) in enumerate(ranked):
        if w in own:
            out.slot[k], free = free, free + 1
            slot_counts[out.slot[k]] += n
            if n:
                held[out.bucket(w) - out.slots + out.buckets] -= n, 1
        else:
            out.slot[k] = out.bucket(w)
    slot_counts[out.slots - out.buckets :] += held[:, 0]
    out.bucket_log, out.slot_counts = np.log10(held.sum(axis=1) + 1), slot_counts
    return out


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A stored table: docs' columns without text, row (a number of its own), slots (16 bits each), n_tokens, known (tokens
    of hot words in training), base (their base score; others count 0), word_log (log10 of P(word | slot), others without
    their own count) and rest (word and times, of words that aren't hot)."""
    now = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c not in ("text", *CODED)]
    fields = "slots binary, n_tokens long, known long, base double, word_log double, rest array<struct<word:binary,times:int>>"
    whole = docs.select(*kept).schema

    def make():
        v = now.value
        get, slot_of, known_of = v.place.get, np.append(v.slot, 0).astype(np.uint16), np.append(v.counts > 0, False)
        all_log, first = float(np.log10(v.total + v.kinds + 1)), v.slots - v.buckets
        log_of = np.append(np.log10(v.counts + 1.0), 0.0)
        shared = slot_of >= first
        shared[-1] = False
        word_log_of = np.where(shared, log_of - v.bucket_log[np.where(shared, slot_of - np.uint16(first), 0)], 0.0)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            slots, sizes, sums, rest = [b""] * n, np.zeros(n, np.int64), np.zeros((n, 3)), [Counter() for _ in range(n)]

            def take(part: list[tuple[int, list[bytes]]]) -> None:
                flat = [w for _, x in part for w in x]
                at = np.fromiter(map(get, flat, repeat(-1)), np.int32, len(flat))
                own = slot_of[at]
                cold = np.flatnonzero(at < 0)
                words = [flat[i] for i in cold.tolist()]
                own[cold] = [first + zlib.crc32(w) % v.buckets for w in words]
                word_log = word_log_of[at]
                word_log[cold] = -v.bucket_log[own[cold] - np.uint16(first)]
                ends = np.cumsum([len(x) for _, x in part])
                cuts = np.searchsorted(cold, ends).tolist()
                begin = done = 0
                for (k, x), end, cut in zip(part, ends.tolist(), cuts, strict=True):
                    s = slice(begin, end)
                    slots[k] += own[s].tobytes()
                    sizes[k] += len(x)
                    sums[k] += known_of[at[s]].sum(), log_of[at[s]].sum(), word_log[s].sum()
                    rest[k].update(words[done:cut])
                    begin, done = end, cut

            part, size = [], 0
            for k, x in pieces(batch.column("text").to_pylist()):
                if x:
                    part.append((k, x))
                    size += len(x)
                if size > PIECE // 8:
                    take(part)
                    part, size = [], 0
            if part:
                take(part)
            ends = np.cumsum([0, *map(len, rest)])
            left = pa.StructArray.from_arrays([pa.array([w for x in rest for w in x], pa.binary()), pa.array([m for x in rest for m in x.values()], pa.int32())], ["word", "times"])
            columns = [pa.array(slots, pa.binary()), pa.array(sizes), pa.array(sums[:, 0].astype(np.int64)), pa.array(sums[:, 1] - sizes * all_log), pa.array(sums[:, 2]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), left)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "slots", "n_tokens", "known", "base", "word_log", "rest"])

        return work

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in whole), fields])
    return stored(map_rows(docs.select(*kept, "text"), schema, make, 256).withColumn("row", F.monotonically_increasing_id()))


@dataclass
class Weights:
    """Logits by feature: bias of the classes, rows of the last slot, the skipped one and both, for classes; bias of the
    members of each class, and rows of class and last slot, for members."""

    bias: np.ndarray
    last: np.ndarray
    skip: np.ndarray
    both: np.ndarray
    inner: np.ndarray
    member: np.ndarray

    @staticmethod
    def unigram(slot_counts: np.ndarray, classes: int) -> Weights:
        grid = slot_counts.reshape(classes, -1)
        zero = lambda n: np.zeros((n, classes), np.float32)
        inner = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
        member = np.zeros((classes * member_rows(classes, grid.size), grid.shape[1]), np.float32)
        return Weights(np.log(grid.sum(axis=1) / grid.sum()).astype(np.float32), zero(grid.size), zero(grid.size), zero(TRIGRAMS), inner, member)

    def tables(self) -> list[np.ndarray]:
        """Rows for classes."""
        return [self.last, self.skip, self.both]

    def member_log(self) -> np.ndarray:
        """Natural logarithm of the members' probabilities by row."""
        out = self.member + np.repeat(self.inner, len(self.member) // len(self.inner), axis=0)
        out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
        return out


def member_rows(classes: int, slots: int) -> int:
    """Rows of a class: one for each last slot, or as many hash values."""
    return min(slots, MEMBER_ROWS // classes)


def features(one: np.ndarray, two: np.ndarray, own: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
    """Rows of last, skip, both and member for each token; one, two: the slots before it; shape: classes, members."""
    classes, members = shape
    rows = member_rows(classes, classes * members)
    last = one if rows == classes * members else (one * 2654435761 >> 7) % rows
    return [one, two, ((one * 40503 + two) * 2654435761 >> 8) % TRIGRAMS, own // members * rows + last]


def chunks(column: pa.Array, end: int, shape: tuple[int, int], step: int = 1 << 15) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(place, slots, their features) of neighbouring tokens of a column of slots; before a document stand ends."""
    if not len(column):
        return
    wide = column.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] // 2
    flat = np.frombuffer(wide.buffers()[2], np.uint16, int(ends[-1]))[ends[0] :]
    first = np.zeros(len(flat), bool)
    first[ends[:-1] - ends[0]] = True
    for low in range(0, len(flat), step):
        at = np.arange(low, min(low + step, len(flat)))
        one, two, own = flat[np.maximum(at - 1, 0)].astype(np.int64), flat[np.maximum(at - 2, 0)].astype(np.int64), flat[at].astype(np.int64)
        one[first[at]] = end
        two[first[at] | first[np.maximum(at - 1, 0)]] = end
        yield low, own, features(one, two, own, shape)


def class_odds(tables: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Unnormalised probabilities' logarithms of all classes; the bias is in the first table. None is far above 0."""
    a = tables[0][rows[0]]
    a += tables[1][rows[1]]
    a += tables[2][rows[2]]
    return a


def expected(met: np.ndarray, tables: list[np.ndarray], sums: list[np.ndarray], shape: tuple[int, int], step: int = 1 << 14) -> None:
    """Add to sums how often the model expects each class after each of these histories (last slot times slots, and the one
    before it). What is expected follows from the history alone, so that each different one is worked out once."""
    slots = shape[0] * shape[1]
    kinds, times = np.unique(met, return_counts=True)
    for low in range(0, len(kinds), step):
        one, two = np.divmod(kinds[low : low + step], slots)
        rows = features(one, two, one, shape)[: len(tables)]
        p = class_odds(tables, rows)
        np.exp(p, out=p)
        p *= UNIT / p.sum(axis=1, keepdims=True)
        whole = np.rint(p, out=p).astype(np.int64)
        whole *= times[low : low + step, None]
        for total, row in zip(sums, rows, strict=True):
            order = np.argsort(row.astype(np.uint16), kind="stable")
            same = row[order]
            begin = np.flatnonzero(np.diff(same, prepend=-1))
            total[same[begin]] += np.add.reduceat(whole[order], begin, axis=0)


def gather(now, end: int, expect: bool):
    """A task's sums. Without `expect`: how often rows met classes and members; else how often classes were expected."""

    def run(batches):
        w = now.value
        tables, shape = [w.last + w.bias, *w.tables()[1:]], w.inner.shape
        members = shape[1]
        sums = [np.zeros(t.shape, np.int64) for t in (tables if expect else [*tables, w.member])]
        met, held = [], 0
        for batch in batches:
            for _, own, rows in chunks(batch.column("slots"), end, shape):
                if not expect:
                    for total, row, value in zip(sums, rows, [own // members] * 3 + [own % members], strict=True):
                        np.add.at(total.reshape(-1), row * total.shape[1] + value, 1)
                    continue
                met.append(rows[0] * w.inner.size + rows[1])
                held += len(own)
                if held > HISTORIES:
                    expected(np.concatenate(met), tables, sums, shape)
                    met, held = [], 0
        if met:
            expected(np.concatenate(met), tables, sums, shape)
        part = TaskContext.get().partitionId() // 256
        for k, total in enumerate(sums):
            cut = total.reshape(-1, BLOCK * total.shape[1])
            hit = np.flatnonzero(cut.any(axis=1))
            for low in range(0, len(hit), 256):
                some = hit[low : low + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(some), pa.int32()), pa.array([k] * len(some), pa.int32()), pa.array(some.astype(np.int32)), pa.array([packed(cut[b]) for b in some], pa.binary())],
                    ["part", "table", "block", "sums"],
                )

    return run


def packed(sums: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    return zlib.compress(sums.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def added(group: pa.Table) -> pa.Table:
    """The sums of one block; of 256 tasks, or of all that were added up before."""
    total = 0
    for x in group.column("sums"):
        total = total + unpacked(x.as_py())
    keys = [group.column(c)[:1].cast(pa.int32()) for c in ("part", "table", "block")]
    return pa.table([*keys, pa.array([packed(total)], pa.binary())], names=["part", "table", "block", "sums"])


def gathered(slots: DataFrame, weights: Weights, end: int, expect: bool) -> list[np.ndarray]:
    """gather()'s sums over all rows of slots. As large as the weights, whatever the input."""
    now, schema = slots.sparkSession.sparkContext.broadcast(weights), "part int, table int, block int, sums binary"
    files = max(1, len(slots.inputFiles()) // 4)  # slots are a small part of a table's files: a task takes several
    sums = slots.select("slots").coalesce(files).mapInArrow(gather(now, end, expect), schema)
    for keys in (["part", "table", "block"], ["table", "block"]):
        sums = sums.groupBy(*keys).applyInArrow(added, schema)
    out = [np.zeros(t.shape, np.int64) for t in [*weights.tables(), *([] if expect else [weights.member])]]
    for r in sums.collect():
        out[r["table"]].reshape(-1, BLOCK * out[r["table"]].shape[1])[r["block"]] = unpacked(r["sums"])
    now.unpersist()
    return out


def train(slots: DataFrame, vocabulary: Vocabulary, rounds: int = 2, rate: float = 0.45, prior: float = 400.0, member_prior: float = 40.0) -> Weights:
    """slots: the rows of encoded() that are learned from; all of them take part in every round."""
    w = Weights.unigram(vocabulary.slot_counts, vocabulary.classes)
    p = np.exp(w.bias.astype(float))
    met = expected = []
    for turn in range(rounds):
        if turn == 0:
            *met, members = gathered(slots, w, vocabulary.end, False)
            settle_members(w, members, member_prior)
            del members
        else:
            expected = gathered(slots, w, vocabulary.end, True)
        for k, t in enumerate(w.tables()):
            for rows in blocks(len(t)):
                m = met[k][rows].astype(float)
                e = expected[k][rows] / UNIT if turn else m.sum(axis=1, keepdims=True) * p  # what the unigram model expects
                t[rows] += 2 * rate * (m - e) / (m + e + 2 * prior * p)
    return w


def blocks(n: int, step: int = 2048) -> Iterator[slice]:
    return (slice(k, k + step) for k in range(0, n, step))


def settle_members(w: Weights, met: np.ndarray, prior: float, steps: int = 8) -> None:
    """Gradient steps for the members; `prior` tokens of the unigram model are added to each row."""
    each = len(met) // len(w.inner)
    for rows in blocks(len(met)):
        inner = w.inner[np.arange(len(met))[rows] // each].astype(float)
        seen = met[rows] + prior * np.exp(inner)
        total, now = seen.sum(axis=1, keepdims=True), inner.copy()
        for _ in range(steps):
            e = np.exp(now)
            e *= total / e.sum(axis=1, keepdims=True)
            now += 2 * (seen - e) / (seen + e)
        w.member[rows] = now - inner


def log_probabilities(tables: list[np.ndarray], member_log: np.ndarray, own: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each slot's probability."""
    members = member_log.shape[1]
    a = class_odds(tables, rows)
    out = a[np.arange(len(own)), own // members].astype(float)
    np.exp(a, out=a)
    return out - np.log(a.sum(axis=1)) + member_log[rows[3], own % members]


def score(table: DataFrame, counts: DataFrame, vocabulary: Vocabulary, weights: Weights) -> DataFrame:
    """table, an encoded(), with n_known, base_score and score in place of row, slots, known, base, word_log and rest.
    counts: word, n."""
    now, end = table.sparkSession.sparkContext.broadcast(weights), vocabulary.end
    kept = [c for c in table.columns if c == "n_tokens" or c not in (*CODED, *SCORED)]
    whole = table.select(*kept, "known", "base").schema

    def make():
        w = now.value
        tables, member_log = [w.last + w.bias, *w.tables()[1:]], w.member_log()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = batch.column("n_tokens").to_numpy()
            logs = np.zeros(int(sizes.sum()))
            for low, own, rows in chunks(batch.column("slots"), end, w.inner.shape):
                logs[low : low + len(own)] = log_probabilities(tables, member_log, own, rows)
            model = np.add.reduceat(logs, np.cumsum(sizes) - sizes) / np.log(10) + batch.column("word_log").to_numpy() if len(sizes) else np.zeros(0)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*kept, "known", "base"]), pa.array(model), batch.column("row")], [*kept, "known", "base", "model", "row"])

        return work

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in whole), "model double, row long"])
    parts = map_rows(table.drop("rest", *SCORED), schema, make, 2048)
    cold = counts.filter(F.col("n") * HOT < vocabulary.total)
    more = table.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times").join(cold, "word")
    more = more.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log"), F.sum("times").alias("seen"))
    log, seen = F.coalesce("log", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    found = parts.join(more, "row", "left")
    return found.select(*kept, (F.col("known") + seen).alias("n_known"), (F.col("base") + log).alias("base_score"), (F.col("model") + log).alias("score"))
