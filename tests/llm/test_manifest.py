"""Merkle manifests against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """The root, and by leaf its steps (place, siblings)."""
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            own = digests[i - i % 8 : i - i % 8 + 8]
            proofs[k].append((i % 8, "".join(own[: i % 8] + own[i % 8 + 1 :])))
            at[k] = i // 8
        digests = [sha("".join(digests[i : i + 8])) for i in range(0, len(digests), 8)]
    return digests[0], proofs


def plain(rows):
    """(doc_id, leaf, subroot, root, proof) of rows of doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[g] = own, *tree([leaf(r) for r in own])
    root, above = tree([inner[g][1] for g in order])
    return [(r[0], leaf(r), inner[g][1], root, p + up) for g, up in zip(order, above, strict=True) for r, p in zip(inner[g][0], inner[g][2], strict=True)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(sizes):
    rows = []
    for lang, n in sizes.items():
        rows += [(len(rows) * 7 % 1009 + len(rows) // 3, None if k % 5 == 0 else f"s{k}", lang, None if k % 7 == 0 else k, None if k % 11 == 0 else f"Text Ä {k}\n" * (k % 4)) for k in range(n)]
    return rows + [(None, None, None, None, None), (None, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (5, "b", "en", 1, "x"), (9, "z", "en", 9, "long " * 50_000)]


def compared(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["at"], s["others"]) for s in r["proof"]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [2, 5, manifest.CHUNK_BITS])
def test_manifest(spark, bits, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK_BITS", bits)
    rows = made({"en": 530, "de": 64, "fr": 65, "é": 1, "": 9, None: 17, "-": 8} | {f"x{k}": 1 + k % 3 for k in range(12)})
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"g": F.lit("g"), "_at": F.lit(1), "digest": F.lit("d")})
    assert compared(manifest.manifest(docs)) == sorted(plain(rows), key=repr)


def test_one_row_and_none(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "s", "en", 2, "ab")]
    assert compared(manifest.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_query(spark, tmp_path):
    rows = [r for r in made({"en": 100, None: 9, "de": 3}) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    by_leaf = {leaf(r): r for r in rows}
    for doc_id, digest, subroot, root, proof in plain(rows):
        r = by_leaf[digest]
        odd = zlib.crc32(str(doc_id).encode()) % 3 == 0 and r[4] is not None
        now = leaf((*r[:4], r[4].translate(LOW))) if odd else digest
        for at, others in proof:
            now = sha(others[: 64 * at] + now + others[64 * at :])
        want.append((doc_id, digest, subroot, root, sha("".join(o for _, o in proof)), now, now == root))
    got = sorted(tuple(r) for r in queries.op12_manifest(spark, str(tmp_path)).collect())
    assert got == sorted(want)
    assert {v for *_, v in got} == {True, False}
