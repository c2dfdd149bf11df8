"""Document fingerprints against plain Python."""

import hashlib
import random
import struct
from math import log

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import multiset, queries
from tests.llm.test_text_operators import DOCS, awkward


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


def paragraphs(text):
    return [p for p in (x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")) if p]


def plain_lanes(text):
    out = [0] * (multiset.CHECKS + multiset.LEVELS * multiset.LANES)
    for p in paragraphs(text):
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        v, w = (xxhash.xxh64_intdigest(struct.pack("<i", k), h) for k in (1, 2))
        for k, x in enumerate((h, v >> 32, w, w >> 32)):
            out[k] = (out[k] + x) % 2**32
        for level in range(multiset.LEVELS):
            if w % 4**level == 0:
                k = multiset.CHECKS + level * multiset.LANES + (h >> 5 * level + 20) % multiset.LANES
                out[k] = (out[k] + v) % 2**32
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    found = []
    for level in range(multiset.LEVELS):
        s = slice(multiset.CHECKS + level * multiset.LANES, multiset.CHECKS + (level + 1) * multiset.LANES)
        pairs = list(zip(a[s], b[s], strict=True))
        found.append((sum(x != 0 or y != 0 for x, y in pairs), sum(x != y for x, y in pairs)))
    found = [x for x in found if x[0]]
    used, unlike = next((x for x in found if x[0] <= multiset.CROWDED), found[-1])
    guess = lambda n: -log(1 - min(n, multiset.LANES - 0.5) / multiset.LANES)
    return max(0.0, 1 - guess(unlike) / guess(used))


def alike(spark, pairs):
    df = spark.createDataFrame(pairs, "x string, y string").select(multiset.lanes(F.col("x")).alias("a"), multiset.lanes(F.col("y")).alias("b"))
    return df.select("a", "b", multiset.likeness(F.col("a"), F.col("b")).alias("near"))


def test_order_white_space_and_multiplicity(spark):
    pairs = [("a\nb\nc", "c\na\nb"), ("a\n\nb", "b\n a "), ("a", "a\na"), (None, ""), ("a\nb", "a"), ("a\r\nb\r\n", "a\nb\n"), (" \t ", "")]
    assert [r["a"] == r["b"] for r in alike(spark, pairs).collect()] == [True, True, False, True, False, True, True]


def test_insertion_and_deletion(spark):
    one = spark.createDataFrame([("a\nb\nc", "a\nc", "b")], "x string, y string, z string").select(*(multiset.lanes(F.col(c)).alias(c) for c in "xyz"))
    r = one.select("x", multiset.add(F.col("y"), F.col("z")).alias("sum"), "y", multiset.subtract(F.col("x"), F.col("z")).alias("less")).first()
    assert r["x"] == r["sum"] and r["y"] == r["less"]


@pytest.mark.parametrize("n", [10, 100, 3000])
def test_likeness_of_half_changed_texts_of_any_length(spark, n):
    pairs = []
    for k in range(40):
        a = [f"{k} line {i}" for i in range(n)]
        pairs.append(("\n".join(a), "\n".join(a[: n // 2] + [f"{k} other {i}" for i in range(n - n // 2)])))
        pairs.append(("\n".join(a), "\n".join(f"{k} no {i}" for i in range(n))))
    near = [r["near"] for r in alike(spark, pairs).collect()]
    half, none = near[::2], near[1::2]
    assert abs(sum(half) / 40 - 1 / 3) < 0.08 and sum(none) / 40 < 0.06
    assert sum(a > b for a, b in zip(half, none, strict=True)) >= 38


def test_query_equals_plain_python(spark, docs, tmp_path):
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("head", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()), reverse=True)
    got = queries.op6_fingerprint(spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"),
    ]
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    as_hex = lambda x: "".join(f"{v:08x}" for v in x)
    for k, (d, t) in enumerate(rows):
        follows, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        a, b, c = map(plain_lanes, (t, edited, follows))
        r = found[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_hex(a), as_hex(b))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((plain_likeness(a, b), plain_likeness(a, c)))


def test_next_document_with_null_and_repeated_ids(spark):
    rng = random.Random(1)
    rows = [(rng.choice((None, 1, 5, -(2**63), 7, *range(20, 60))), rng.choice("abcdefgh") * 4) for _ in range(150)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, head int").repartition(5)
    found = multiset.with_next(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in found) == sorted((d is None, d or 0, t) for d, t in rows)

    def signed(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - 2**64 if h >> 63 else h

    order = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    follows = {r: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    assert all(r["head"] == follows[r["doc_id"], r["text"]][1][:2] for r in found)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    assert [r["head"] for r in multiset.with_next(df).collect()] == ["ab"]
    assert multiset.with_next(df.limit(0)).count() == 0
