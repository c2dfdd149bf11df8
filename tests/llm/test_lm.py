"""Language-model scores against a plain model of dictionaries."""

import random
import zlib
from collections import Counter, defaultdict
from math import exp, log, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm, queries
from tests.llm.test_text_operators import DOCS, awkward


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


def words_of(text):
    return [*(w for w in (text or "").encode().lower().split()), b""]


class Plain:
    """The same model by the book: dictionaries, one token at a time."""

    def __init__(self, learned, rate=0.45, prior=400.0, member_prior=40.0, side=32):
        self.side, self.slots, self.buckets = side, side * side, side * side // 16
        self.c = Counter(w for t in learned for w in words_of(t))
        self.n, self.v = sum(self.c.values()), len(self.c)
        ranked = sorted((w for w in self.c if self.c[w] * lm.HOT >= self.n or not w), key=lambda w: (-self.c[w], w))
        own = {*ranked[: self.slots - self.buckets - 1], b""}
        self.own = {w: k for k, w in enumerate(w for w in ranked if w in own)}
        self.held = defaultdict(lambda: [0, 0])
        met = [1.0] * self.slots
        for w, n in self.c.items():
            met[self.slot(w)] += n
            if w not in self.own:
                self.held[self.slot(w)][0] += n
                self.held[self.slot(w)][1] += 1
        of_class = [sum(met[k * side : k * side + side]) for k in range(side)]
        self.p = [x / sum(met) for x in of_class]
        self.q = [[met[k * side + m] / of_class[k] for m in range(side)] for k in range(side)]
        self.w, self.member = [defaultdict(lambda: [0.0] * side) for _ in range(3)], {}
        seen, inside = [defaultdict(lambda: [0.0] * side) for _ in range(3)], defaultdict(lambda: [0.0] * side)
        for t in learned:
            for at, s in self.walk(t):
                for k in range(3):
                    seen[k][at[k]][s // side] += 1
                inside[s // side, at[0]][s % side] += 1
        for (k, last), row in inside.items():
            total = sum(row) + member_prior
            self.member[k, last] = [(x + member_prior * q) / total for x, q in zip(row, self.q[k], strict=True)]
        expected = [{r: [sum(x) * p for p in self.p] for r, x in table.items()} for table in seen]
        for turn in range(2):
            if turn:
                expected = [defaultdict(lambda: [0.0] * side) for _ in range(3)]
                for t in learned:
                    for at, _ in self.walk(t):
                        for k in range(3):
                            expected[k][at[k]] = [a + b for a, b in zip(expected[k][at[k]], self.classes(at), strict=True)]
            steps = [{r: [2 * rate * (o - e) / (o + e + 2 * prior * p) for o, e, p in zip(x, expected[k][r], self.p, strict=True)] for r, x in seen[k].items()} for k in range(3)]
            for k in range(3):
                for r, step in steps[k].items():
                    self.w[k][r] = [a + b for a, b in zip(self.w[k][r], step, strict=True)]

    def slot(self, w):
        return self.own.get(w, self.slots - self.buckets + zlib.crc32(w) % self.buckets)

    def walk(self, text):
        one = two = self.own.get(b"", 0)
        for w in words_of(text):
            s = self.slot(w)
            yield (one, two, ((one * 40503 + two) * 2654435761 >> 8) % lm.TRIGRAMS), s
            one, two = s, one

    def classes(self, at):
        odds = [p * exp(sum(self.w[k][at[k]][c] if at[k] in self.w[k] else 0.0 for k in range(3))) for c, p in enumerate(self.p)]
        return [x / sum(odds) for x in odds]

    def score(self, text):
        total = 0.0
        for (at, s), w in zip(self.walk(text), words_of(text), strict=True):
            k, m = divmod(s, self.side)
            total += log(self.classes(at)[k]) + log(self.member.get((k, at[0]), self.q[k])[m])
            if w not in self.own:
                total += log((self.c[w] + 1) / (sum(self.held[s]) + 1))
        return total / log(10)


def fitted(known):
    counts = lm.count_words(known).cache()
    vocabulary = lm.vocabulary(counts)
    return counts, vocabulary, lm.train(lm.encoded(known, vocabulary), vocabulary)


def test_scores_equal_the_plain_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 150)  # so that there are words which aren't hot
    known = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    counts, vocabulary, weights = fitted(known)
    assert len(vocabulary.place) < vocabulary.kinds
    rows = lm.score(lm.encoded(docs, vocabulary), counts, vocabulary, weights).collect()
    assert len(rows) == docs.count()
    plain = Plain([r["text"] for r in known.collect()])
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    n, v = plain.n, plain.v
    for r in rows:
        words = words_of(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(plain.c[w] > 0 for w in words))
        assert r["base_score"] == pytest.approx(sum(log10((plain.c[w] + 1) / (n + v + 1)) for w in words))
        assert r["score"] == pytest.approx(plain.score(text[r["doc_id"]]), rel=2e-3)


def test_scores_of_unseen_words_with_buckets(spark):
    """More words than slots of their own: histories and targets that are buckets."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.35))}" for _ in range(300))) for k in range(60)]
    known = spark.createDataFrame(rows[:50], "doc_id long, text string").repartition(3)
    counts, vocabulary, weights = fitted(known)
    assert vocabulary.kinds > vocabulary.slots
    plain = Plain([t for _, t in rows[:50]])
    every = spark.createDataFrame(rows, "doc_id long, text string")
    for r in lm.score(lm.encoded(every, vocabulary), counts, vocabulary, weights).collect():
        assert r["score"] == pytest.approx(plain.score(rows[r["doc_id"]][1]), rel=2e-3)


def test_weights_do_not_depend_on_how_rows_are_dealt(spark, docs):
    _, _, one = fitted(docs.repartition(1))
    _, _, more = fitted(docs.repartition(7, "text"))
    for a, b in zip((one.bias, *one.tables(), one.inner, one.member), (more.bias, *more.tables(), more.inner, more.member), strict=True):
        assert np.array_equal(a, b)


def test_every_token_of_every_document_takes_part(spark, docs):
    _, vocabulary, weights = fitted(docs)
    slots = lm.encoded(docs, vocabulary)
    met = lm.gathered(slots, weights, vocabulary.end, False)
    assert [int(m.sum()) for m in met] == [vocabulary.total] * 4
    expected = lm.gathered(slots, weights, vocabulary.end, True)
    assert all(e.sum() / lm.UNIT == pytest.approx(vocabulary.total, rel=1e-2) for e in expected)


def test_probabilities_of_all_words_add_up_to_one(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(0.35))}" for _ in range(200))) for k in range(50)], "doc_id long, text string")
    counts, v, w = fitted(rows)
    tables, member_log = [w.last + w.bias, *w.tables()[1:]], w.member_log()
    word_log = {}
    for r in counts.collect():
        s = int(v.slot[v.place[bytes(r["word"])]]) if bytes(r["word"]) in v.place else v.bucket(bytes(r["word"]))
        own = s < v.slots - v.buckets
        word_log.setdefault(s, []).append(0.0 if own else log10(r["n"] + 1) - v.bucket_log[s - v.slots + v.buckets])
    for b in range(v.buckets):
        word_log.setdefault(v.slots - v.buckets + b, []).append(-v.bucket_log[b])  # all words that were never seen
    every = np.arange(v.slots)
    for one, two in ((3, 8), (v.end, v.end), (v.slots - 1, 5)):
        at = lm.features(np.full(v.slots, one), np.full(v.slots, two), every, (v.classes, v.members))
        p = np.exp(lm.log_probabilities(tables, member_log, every, at))
        assert p.sum() == pytest.approx(1, abs=1e-4)
        assert sum(10 ** sum(word_log[s]) if len(word_log[s]) == 1 else sum(10**x for x in word_log[s]) for s in word_log if s >= v.slots - v.buckets) == pytest.approx(v.buckets, rel=1e-6)


@pytest.mark.parametrize("piece", [1 << 21, 50])
def test_long_texts_in_pieces(spark, docs, monkeypatch, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    texts = [r["text"] for r in docs.collect()]
    joined = [[] for _ in texts]
    for k, x in lm.pieces(texts):
        joined[k] += x
    assert joined == [words_of(t) for t in texts]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    counts, vocabulary, weights = fitted(none)
    assert lm.score(lm.encoded(docs, vocabulary), counts, vocabulary, weights).count() == docs.count()
    counts, vocabulary, weights = fitted(docs)
    assert lm.score(lm.encoded(none, vocabulary), counts, vocabulary, weights).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(("the river", "a bird", "walks", f"w{k}")) for _ in range(20)) if k % 9 else None, "clash") for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op5_lm_scoring(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double"),
    ]
    held = {k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2}
    learned = [t for k, t, _ in rows if k not in held]
    plain, text = Plain(learned), {k: t for k, t, _ in rows}
    for r in found.collect():
        assert r["held_out"] == (r["doc_id"] in held) and r["train_tokens"] == plain.n
        assert r["score"] == pytest.approx(plain.score(text[r["doc_id"]]), rel=2e-3)


def test_a_history_is_worked_out_once(monkeypatch):
    """Expected counts are those of all tokens one by one, from one row of odds for each different history."""
    rng, shape = np.random.default_rng(3), (4, 8)
    tables, seen = [rng.normal(size=(n, 4)).astype(np.float32) for n in (32, 32, lm.TRIGRAMS)], []
    monkeypatch.setattr(lm, "class_odds", lambda t, rows, plain=lm.class_odds: seen.append(len(rows[0])) or plain(t, rows))
    met = rng.integers(0, 32, 5000) * 32 + rng.integers(0, 5, 5000)
    sums = [np.zeros(t.shape, np.int64) for t in tables]
    lm.expected(met, tables, sums, shape)
    assert sum(seen) == len(set(met.tolist())) == 160
    rows = lm.features(met // 32, met % 32, met // 32, shape)[:3]
    p = np.exp(tables[0][rows[0]] + tables[1][rows[1]] + tables[2][rows[2]])
    p *= lm.UNIT / p.sum(axis=1, keepdims=True)
    for total, row in zip(sums, rows, strict=True):
        want = np.zeros(total.shape, np.int64)
        np.add.at(want, row, np.rint(p).astype(np.int64))
        assert (total == want).all()
