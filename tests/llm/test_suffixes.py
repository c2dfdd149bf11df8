"""Suffix arrays, prefixes and repeats against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import queries, suffixes


def plain(rows):
    """doc_id, text -> bytes, and which of them a 50-byte string of a smaller id covers."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            if i is not None:
                first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if i is not None and first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((i, len(b), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def made(seed=4, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        rows.append((k, "\n".join(parts)))
    rows += [(900 + k, rows[k * 3][1]) for k in range(20)]  # whole copies
    rows += [(950, None), (951, ""), (952, "a" * 400), (953, "a" * 49), (954, "b" + "a" * 300 + "c"), (955, passages[0][:49]), (956, passages[0][:50])]
    rows += [(None, rows[5][1]), (7, rows[8][1]), (7, rows[7][1]), (3, "zz " * 100), (1, "zz " * 90)]
    rows.append((2000, " ".join(word() for _ in range(9000)) + passages[3]))
    return rows


def found(df):
    return sorted([(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()], key=repr)


@pytest.mark.parametrize(("shard", "often", "limit", "least"), [(suffixes.SHARD, suffixes.OFTEN, suffixes.SLICE, suffixes.COMMON), (7, 2, 3000, 2), (40, 1000, 1 << 24, 4), (1000, 3, 2000, 1000)])
def test_repeats(spark, shard, often, limit, least):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": queries.F.lit(1), "at": queries.F.lit("x"), "bucket": queries.F.lit(None)}).repartition(5)
    assert found(suffixes.repeats(docs, shard, often, limit, least=least)) == plain(rows)


def test_repeats_of_nothing(spark):
    assert suffixes.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, None), (2, ""), (None, None)]
    assert found(suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for n, letters in ((60, 1), (400, 2), (3000, 2), (5000, 4)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]  # a long repeat
        low = np.arange(0, n - 60, 61) if n > 61 else np.array([0])
        counts = np.minimum(12, n - low)
        wanted = np.zeros(n, bool)
        wanted[suffixes.ranges(low, counts)] = True
        sa = suffixes.suffix_array(text, wanted)
        held = text.tobytes() + bytes(60)
        keys = [held[i : i + 50] for i in sa.tolist()]
        assert keys == sorted(keys) and sorted(sa.tolist()) == np.flatnonzero(wanted).tolist()
        same = [0, *(next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(keys, keys[1:], strict=False))]
        assert suffixes.common_prefixes(text, sa, wanted, low, counts).tolist() == same


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    text = "".join(rng.choice("ab ") for _ in range(70_000)).encode()
    whole = np.frombuffer(text, np.uint8)
    place, key, first, count = suffixes.anchors(whole, np.array([len(text)]))
    assert count.sum() == len(text) - 49 and (np.diff(place) > 0).all()
    for low in (0, 32_760, 33_000):  # a part of it alone has the same anchors
        part = whole[low : low + 500]
        p, k, f, c = suffixes.anchors(part, np.array([500]))
        inner = (f > 0) & (f + c < 451)
        of = {int(a): (int(b), int(x), int(n)) for a, b, x, n in zip(place - low, key, first - low, count, strict=True)}
        assert inner.any() and all(of[int(a)] == (int(b), int(x), int(n)) for a, b, x, n in zip(p[inner], k[inner], f[inner], c[inner], strict=True))


def test_query(spark, tmp_path):
    rows = [r for r in made(9, 80) if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_suffixes(spark, str(tmp_path)).collect())
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in plain(rows)]
    assert got == sorted(want)
