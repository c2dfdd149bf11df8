"""SimHash fingerprints and the groups of those that differ in few bits.

A bit of the fingerprint is set if it is set in over half of the hashes (XXH64, seed 42) of a text's word
shingles. To link fingerprints of 2 bits' difference or less, the 64 bits are cut into segments of 22, 21
and 21 bits. Two errors leave one segment whole, and of each cyclic pair of segments some pair has its first
segment whole and at most one error in the second. The second segment, as a word of the [23, 12] code, is
decoded together with its one-bit neighbours into nearby codeword indices: words one error apart share one.
(pair, first segment, index) is the join key; the bit count of the XOR verifies each candidate.

Keys under which more than `most` fingerprints lie aren't expanded into pairs. Those fingerprints meet at
their midpoints instead: two that differ in 2 bits have a third one bit from both, so that each sends itself
to its 65 neighbours and links to the smallest that meets it there. That is exact, and 65 at most meet.

Null and empty texts have fingerprint 0. Copies share one fingerprint and are linked once. Rows without a
doc_id get the group of their fingerprint, but link nothing themselves.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import golay
from tessera.llm.common import by_size, discard, map_rows, sampled, stored
from tessera.operators.graph import connected_components

SEED = 42
#: Lowest bit and width of the segments, and the pairs of (whole, decoded) segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (1, 2), (2, 0))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(found: list[bytes], k: int) -> np.ndarray:
    """XXH64 of the k-word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    if not found:
        return np.zeros(0, np.uint64)
    rows = zip(*(found[i:] for i in range(k)), strict=False) if len(found) >= k else [found]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([digest(join(r), SEED) for r in rows], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 20_000):
        part = np.ascontiguousarray(hashes[start : start + 20_000], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp of every row."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(shingle_hashes(words(t), k)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.int64())], ["doc_id", "fp"])

        return work

    return map_rows(docs.select("doc_id", "text"), "doc_id long, fp long", make, 128)


def keyed(nodes: DataFrame, probe: bool) -> DataFrame:
    """key, id, fp: a row for each of a fingerprint's keys. Of the side to be probed, a segment has its own index only."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            part = [(fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
            keys, rows = [], []
            for pair, (whole, fuzzy) in enumerate(PAIRS):
                index = np.sort(golay.near(part[fuzzy], SEGMENTS[fuzzy][1]), axis=1) if probe else golay.decode(part[fuzzy])[:, None]
                first = np.ones(index.shape, bool)
                first[:, 1:] = index[:, 1:] != index[:, :-1]
                row, column = np.nonzero(first)
                keys.append((pair << 22 | part[whole][row]) << 12 | index[row, column])
                rows.append(row)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(batch.column(c).take(pa.array(np.concatenate(rows))) for c in ("id", "fp"))], ["key", "id", "fp"])

        return work

    return map_rows(nodes.select("id", "fp"), "key long, id long, fp long", make, 20_000)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, most: int = 64) -> DataFrame:
    """a, b: ids of different fingerprints within 2 bits, enough of them to connect all such. nodes: id, fp, each once."""
    indexed, probes = stored(keyed(nodes, False)), keyed(nodes, True)
    hot = stored(indexed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"))
    many = indexed.join(hot, "key", "left_semi").select("id", "fp").union(probes.join(hot, "key", "left_semi").select("id", "fp")).distinct()
    left = indexed.join(hot, "key", "left_anti").select("key", F.col("id").alias("a"), F.col("fp").alias("fa"))
    right = probes.join(hot, "key", "left_anti").select("key", F.col("id").alias("b"), F.col("fp").alias("fb"))
    found = left.join(right, "key").filter((F.col("fa") < F.col("fb")) & (distance(F.col("fa"), F.col("fb")) <= 2)).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(-(1 << 63) if b == 63 else 1 << b).cast("long") for b in range(64)))
    meeting = many.select("id", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("at"))
    met = meeting.groupBy("at").agg(F.min("id").alias("a"), F.collect_list("id").alias("ids")).filter(F.size("ids") > 1)  # 65 at most
    return found.union(met.select("a", F.explode("ids").alias("b")).filter("a <> b"))


def groups(prints: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of 2 bits or less reach. prints: doc_id, fp."""
    prints = stored(prints)
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    edges = links(nodes.dropna())
    part = connected_components(edges)
    least = stored(nodes.join(part, nodes.id == part.node, "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    return prints.join(least, "fp").select("doc_id", "fp", "component_id")


# Near copies. At a shingle similarity of 0.8 the fingerprints of two texts differ in ten bits on average: links of two
# bits find few of such pairs. So what the fingerprints' groups leave apart is joined by a prefix filter on shingles as well,
# which loses no pair.

#: Share of the texts that tells which shingles are common: those in COMMON of them or more, COMMONEST at most. Any choice
#: gives the same groups, it settles the order of the prefixes only.
SHARE, COMMON, COMMONEST = 1 / 16, 8, 200_000
#: Keys of more texts than this are joined last, and only between groups that the others left apart.
MOST = 64


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n distinct hashes, sorted, in an order that all texts share: the common
    ones come last, by rank. Of two sets of this similarity or more, the prefixes share one at least."""
    n = len(hashes)
    if not n:
        return hashes
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        known = common[at] == hashes
        hashes = np.concatenate([hashes[~known], common[at[known]][np.argsort(rank[at[known]])]])
    return hashes[: n - ceil(similarity * n - 1e-9) + 1]


def common_shingles(docs: DataFrame, k: int, share: float = SHARE, least: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts of a sample have, and their ranks, rarest first."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, parts = [t or "" for t in batch.column("text").to_pylist()], []
            for a, b in by_size(texts):  # the words of so many characters at once
                parts.append(np.unique(np.concatenate([np.unique(shingle_hashes(words(t), k)) for t in texts[a:b]]), return_counts=True))
            kinds, where = np.unique(np.concatenate([x for x, _ in parts] or [np.zeros(0, np.uint64)]), return_inverse=True)
            n = np.bincount(where, np.concatenate([x for _, x in parts] or [np.zeros(0)]), len(kinds)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

        return work

    part = docs.filter(sampled(F.col("doc_id"), share, SEED)).select("text")
    counts = map_rows(part, "key long, n long", make, 1024).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "key").limit(COMMONEST).collect()
    keys = np.array([r["key"] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], order


def profiles(docs: DataFrame, k: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, copy (hash of the words), size (of the shingle set) and keys (its prefix) of every row."""
    now = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            copy, sizes, keys = [], [], []
            for t in batch.column("text").to_pylist():
                found = words(t)
                hashes = np.unique(shingle_hashes(found, k))
                copy.append(xxhash.xxh3_128_digest(b" ".join(found)))
                sizes.append(len(hashes))
                keys.append(prefix(hashes, similarity, *now.value).view(np.int64))
            columns = [pa.array(copy, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "copy", "size", "keys"])

        return work

    return map_rows(docs.select("doc_id", "text"), "doc_id long, copy binary, size int, keys array<long>", make, 128)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles: distinct hashes (32 bits) of the k-word shingles."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(words(t), k).astype(np.uint32)).view(np.int32) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "shingles"])

        return work

    return map_rows(docs.select("doc_id", "text"), "doc_id long, shingles array<int>", make, 128)


def shared_keys(texts: DataFrame) -> DataFrame:
    """key, id, size, at (the key's place in the prefix), n (texts of the key), for keys of more than one text."""
    every = texts.select("id", "size", F.posexplode("keys").alias("at", "key"))
    return every.join(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")


def candidates(larger: DataFrame, smaller: DataFrame, similarity: float, apart: bool = False) -> DataFrame:
    """a, b: pairs under a key whose sizes and places in the prefix allow the similarity; with `apart`, of different c only.

    The first shingle that two texts share has none before it, so what follows it bounds all they share, which is at least
    similarity / (1 + similarity) of both sizes. In the smaller text (or one as large), then, no more than
    (1 - similarity) / (1 + similarity) of the shingles come before it. Pairs may be found by later ones too.
    """
    need = similarity / (1 + similarity)
    y = smaller.filter(F.col("at") <= F.lit(1 - 2 * need + 1e-9) * F.col("size"))
    x, y = larger.alias("x"), y.alias("y")
    rest = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    fits = (F.col("x.key") == F.col("y.key")) & (F.struct("y.size", "y.id") < F.struct("x.size", "x.id")) & (rest + 1e-6 >= F.lit(need) * (F.col("x.size") + F.col("y.size")))
    if apart:
        fits &= F.col("x.c") != F.col("y.c")
    return x.join(y, fits & (F.col("x.id") != F.col("y.id"))).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def verified(docs: DataFrame, pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """a, b: the pairs whose shingle sets have the similarity."""
    pairs = stored(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    one_each = docs.join(ids.hint("merge"), "doc_id", "left_semi")  # as many ids as the data has: never broadcast
    sets = stored(shingle_sets(one_each, k).distinct().withColumnRenamed("shingles", "s"))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, share: float = SHARE, least: int = COMMON, most: int = MOST, linked: DataFrame | None = None) -> DataFrame:
    """doc_id, component_id: groups of copies and of texts whose k-word shingle sets have a Jaccard similarity of
    `similarity` or more, linked through one another. linked: doc_id, component_id of groups that stand already, like those of
    groups(): they are part of the outcome, and pairs within one aren't verified.

    Copies (equal words) count as one text. Every pair that shares a shingle of both prefixes is a candidate, and all
    candidates are verified by their sets. Under keys of more than `most` texts, each meets two of them first; then the
    texts that this left outside the first one's group meet all that no link connects with them so far. Rows with a null
    doc_id are left out.
    """
    docs_ = docs.filter(F.col("doc_id").isNotNull())
    known = stored(profiles(docs_, k, similarity, common_shingles(docs_, k, share, least)))
    texts = stored(known.groupBy("copy").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    rows, names = stored(known.select("doc_id", "copy")), stored(texts.select("copy", "id"))
    discard(known)
    first = None
    if linked is not None:
        first = stored(names.join(linked, names.id == linked.doc_id).groupBy("id").agg(F.min("component_id").alias("c")))

    def joined(edges: DataFrame) -> DataFrame:
        return edges if first is None else edges.union(first.select(F.col("c").alias("a"), F.col("id").alias("b")).filter("a <> b"))

    def still_apart(pairs: DataFrame) -> DataFrame:
        if first is None:
            return pairs
        ca, cb = (first.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
        return pairs.join(ca, "a", "left").join(cb, "b", "left").filter("not ca <=> cb").select("a", "b")

    shared = stored(shared_keys(texts))
    discard(texts)
    few, hot = shared.filter(F.col("n") <= most), shared.filter(F.col("n") > most)
    pairs, any_hot = candidates(few, few, similarity), not hot.isEmpty()
    if any_hot:
        # the text with the fewest rarer shingles before the key is likest to the others; and another one by hash
        one = F.struct("id", "size")
        centres = stored(hot.groupBy("key").agg(F.min_by(one, F.struct("at", "id")).alias("p"), F.min_by(one, F.xxhash64("id", "key")).alias("q")))
        stars = hot.join(centres, "key").select("id", "size", F.explode(F.array("p", "q")).alias("r"))
        alike_sizes = F.least("size", "r.size") + 1e-6 >= F.lit(similarity) * F.greatest("size", "r.size")
        stars = stars.filter((F.col("id") != F.col("r.id")) & alike_sizes)
        pairs = pairs.union(stars.select(F.least("id", "r.id").alias("a"), F.greatest("id", "r.id").alias("b")))
    alike = stored(verified(docs, still_apart(pairs.distinct()), k, similarity))
    part = connected_components(joined(alike))
    if any_hot:
        part = stored(part)
        grouped = stored(hot.join(part, hot.id == part.node, "left").withColumn("c", F.coalesce("component", "id")).drop("node", "component"))
        main = centres.join(part, F.col("p.id") == part.node, "left").select("key", F.coalesce("component", "p.id").alias("main"))
        out = stored(grouped.join(main, "key").filter("c <> main").drop("main"))  # not in the group of the key's centre
        if not out.isEmpty():
            more = candidates(out, grouped, similarity, True).union(candidates(grouped, out, similarity, True)).distinct()
            part = connected_components(joined(alike.union(verified(docs, more, k, similarity))))
        discard(grouped, out)
    discard(shared)
    least_ = stored(names.join(part, names.id == part.node, "left").select("copy", F.coalesce("component", "id").alias("component_id")))
    return rows.join(least_, "copy").select("doc_id", "component_id")


def first_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8, linked: DataFrame | None = None) -> DataFrame:
    """docs without all but the smallest doc_id of each group of near_duplicates(); one row of each doc_id.

    Rows with a null doc_id can't be told apart and stay.
    """
    groups_ = stored(near_duplicates(docs, k, similarity, linked=linked).groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")))
    kept = groups_.filter("doc_id = c")
    out = docs.join(kept.filter("n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    if not kept.filter("n > 1").isEmpty():
        again = docs.join(kept.filter("n > 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
        out = out.union(again.dropDuplicates(["doc_id"]))
    return out.union(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)
