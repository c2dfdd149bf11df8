"""Merkle manifest of a dataset: a tree of hashes over the rows of each group, one over the groups, and a proof for each row.

A leaf is the hash of a row's fields. Rows are sorted by ranges of group and key; from the counts of each group by
partition follow offsets, and so every leaf's place in its group. A partition's rows are cut into chunks. In a chunk, all
subtrees whose leaves are there are built at once, by runs of `ARITY` aligned to the group's places; only nodes at ragged
ends, whose siblings are elsewhere, are shuffled by their coordinates (group, level, place), level by level, until
each group has its root. Paths come back the same way: from the roots down to the ragged nodes, and in the chunks down to the
leaves. Texts never move: what is sorted and shuffled is hashes and keys.

Null fields count as `-`. Rows of equal keys are in the order of their hashes, and null keys come first; equal rows are
equal leaves, one after another. A null group is a group. Columns that are not named are left out, whatever they are called.
Without rows there are no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

ARITY = 8
#: At most so many neighbouring rows of a partition are a chunk: 2 to this power.
CHUNK_BITS = 14
STEPS = "array<struct<at:int,others:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, `:` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def above(digest: str | list[str]) -> str:
    return hashlib.sha256("".join(digest).encode()).hexdigest()


@dataclass
class Tree:
    """placed: g (group), _at (place in it), _n (rows of it), _chunk, digest and others, a row for each leaf. ragged: g, level,
    at, n (nodes of that level), digest, chunk. levels: tables of g, at, n, digest, kids of the nodes above ragged ones."""

    placed: DataFrame
    ragged: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        found = self.ragged
        for t in self.levels:
            found = found.select("g", "n", "digest").union(t.select("g", "n", "digest"))
        return found.filter("n = 1").select("g", "digest")


def levels_of(n: int) -> int:
    """Levels above the leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def runs(groups: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    start = 0
    for k in range(1, len(groups) + 1):
        if k == len(groups) or groups[k] != groups[start]:
            yield start, k
            start = k


def subtrees(low: int, n: int, digests: list[str]) -> tuple[list[tuple[int, int, list[str]]], list[tuple[int, int, int, str]]]:
    """Of the neighbouring leaves low, low + 1, .. of a group of n: by level, (first place, nodes of the level, digests);
    and the nodes whose parents have other children too, or which are roots: (level, place, nodes of the level, digest)."""
    levels, ragged = [(low, n, digests)], []
    while True:
        high = low + len(digests)
        # complete parents: the last run of a level may be short
        first, last = -(-low // ARITY), (-(-n // ARITY) if high == n else high // ARITY)
        if n == 1 or first >= last:
            ragged += [(len(levels) - 1, low + k, n, d) for k, d in enumerate(digests)]
            return levels, ragged
        whole = range(first * ARITY, min(last * ARITY, high))
        ragged += [(len(levels) - 1, low + k, n, d) for k, d in enumerate(digests) if low + k not in whole]
        digests = [above(digests[max(0, j * ARITY - low) : j * ARITY + ARITY - low]) for j in range(first, last)]
        low, n = first, -(-n // ARITY)
        levels.append((low, n, digests))


def grown(leaves: DataFrame, order: list[Column]) -> Tree:
    """The trees of all groups; leaves: g, digest and others."""
    ranged = leaves.repartitionByRange("g", *order, "digest").sortWithinPartitions("g", *order, "digest")
    rows = stored(ranged.withColumn("_row", F.monotonically_increasing_id()))  # partition and place in it, in one number
    part = F.shiftright("_row", 33).alias("_part")
    counts = rows.groupBy("g", part).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    so_far = Window.partitionBy("g").orderBy("_part")  # one row for each partition of the group
    all_of = Window.partitionBy("g")
    offsets = stored(counts.select("g", "_part", "_first", (F.sum("_rows").over(so_far) - F.col("_rows")).alias("_before"), F.sum("_rows").over(all_of).alias("_n")))
    place = F.col("_row") - F.col("_first") + F.col("_before")
    placed = rows.withColumn("_part", part).join(offsets, ["g", "_part"]).select("*", place.alias("_at"), F.shiftright("_row", CHUNK_BITS).alias("_chunk")).drop("_part", "_first", "_before")

    def build(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_row")
        g, at, n, digest = (chunk.column(c).to_pylist() for c in ("g", "_at", "_n", "digest"))
        found = [(g[a], *node) for a, b in runs(g) for node in subtrees(at[a], n[a], digest[a:b])[1]]
        columns = list(zip(*found, strict=True))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        own = pa.array([chunk.column("_chunk")[0].as_py()] * len(found), pa.int64())
        return pa.table([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), own], ["g", "level", "at", "n", "digest", "chunk"])

    slim = placed.select("g", "_row", "_at", "_n", "digest", "_chunk")
    ragged = stored(slim.groupBy("_chunk").applyInArrow(build, "g string, level int, at long, n long, digest string, chunk long"))
    largest = offsets.agg(F.max("_n")).first()[0] or 0
    tree = Tree(placed, ragged, [])
    for level in range(levels_of(largest)):
        now = ragged.filter((F.col("level") == level) & (F.col("n") > 1)).select("g", "at", "n", "digest")
        if tree.levels:
            now = now.union(tree.levels[-1].filter("n > 1").select("g", "at", "n", "digest"))
        up = now.groupBy("g", F.expr(f"at div {ARITY}").alias("at"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
        up = up.agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("kids"))  # ARITY at most
        tree.levels.append(stored(up.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256))))
    return tree


def paths(tree: Tree, tops: DataFrame) -> DataFrame:
    """chunk, g, level, at, steps and tops' other columns of every ragged node: from it up to its root, then tops.steps.
    tops: g, steps and others."""
    more = [c for c in tops.columns if c not in ("g", "steps")]
    found, known = None, None
    for level in range(len(tree.levels), -1, -1):
        ragged = tree.ragged.filter(F.col("level") == level)
        roots = ragged.filter("n = 1").select("g", "at").union(tree.levels[level - 1].filter("n = 1").select("g", "at")) if level else ragged.filter("n = 1").select("g", "at")
        now = roots.join(tops, "g")
        if level < len(tree.levels):
            kids = tree.levels[level].select("g", F.col("at").alias("_up"), "kids", F.posexplode("kids").alias("_k", "_kid"))
            others = F.filter("kids", lambda kid, k: k != F.col("_k"))
            step = F.struct(F.col("_k").alias("at"), F.array_join(F.transform(others, lambda kid: kid["digest"]), "").alias("others"))
            down = kids.select("g", "_up", F.col("_kid.at").alias("at"), step.alias("_step")).join(known.withColumnRenamed("at", "_up"), ["g", "_up"])
            now = now.unionByName(down.select("g", "at", F.concat(F.array("_step"), "steps").alias("steps"), *more))
        known = stored(now)
        own = ragged.select("chunk", "g", "level", "at").join(known, ["g", "at"])
        found = own if found is None else found.unionByName(own)
    return found


def with_proofs(tree: Tree, ends: DataFrame, keep: list[str]) -> DataFrame:
    """keep and digest of every leaf, with proof (its steps up to the last root) and the other columns of `ends` = paths()."""
    more = [c for c in ends.columns if c not in ("chunk", "g", "level", "at", "steps")]
    rows = tree.placed.select(*keep, "g", "_row", "_at", "_n", "digest", "_chunk")
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, "digest"]), f"proof {STEPS}", *(f"{c} string" for c in more)])
    names = [*keep, "digest", "proof", *more]

    def prove(chunk: pa.Table, tops: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_row")
        known = {(r["g"], r["level"], r["at"]): r for r in tops.to_pylist()}
        g, at, n, digest = (chunk.column(c).to_pylist() for c in ("g", "_at", "_n", "digest"))
        ends_, place, others, told = [0], [], [], {c: [] for c in more}
        for a, b in runs(g):
            levels, _ = subtrees(at[a], n[a], digest[a:b])
            below: dict = {}
            for level in range(len(levels) - 1, -1, -1):
                low, _, nodes = levels[level]
                here = {}
                for k in range(low, low + len(nodes)):
                    up = below.get(k // ARITY)
                    if up is None:
                        top = known[g[a], level, k]
                        here[k] = (tuple((s["at"], s["others"]) for s in top["steps"]), top)
                    else:
                        j = k - k % ARITY
                        siblings = "".join(nodes[max(0, i - low)] for i in range(j, min(j + ARITY, low + len(nodes))) if i != k)
                        here[k] = (((k % ARITY, siblings), *up[0]), up[1])
                below = here
            for k in range(at[a], at[a] + b - a):
                steps, top = below[k]
                for s in steps:
                    place.append(s[0])
                    others.append(s[1])
                ends_.append(len(place))
                for c in more:
                    told[c].append(top[c])
        steps = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(others, pa.string())], ["at", "others"])
        proof = pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), steps)
        return pa.table([*(chunk.column(c) for c in [*keep, "digest"]), proof, *(pa.array(told[c], pa.string()) for c in more)], names)

    return rows.groupBy("_chunk").cogroup(ends.groupBy("chunk")).applyInArrow(prove, schema)


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), also: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root and proof (steps: the node's place among its siblings, and the siblings' hashes, left to right)
    of every row of docs. also: other columns, of docs' columns, that go along.

    Groups come in the order of their values' bytes, null first.
    """
    also = also or {}
    own = docs.select(field(F.col(group)).alias("g"), F.col(key).alias("_key"), leaf(*map(F.col, fields)).alias("digest"), *(c.alias(f"_also_{name}") for name, c in also.items()))
    inner = grown(stored(own), [F.col("_key")])  # the ranges' sample reads hashes, not texts
    name = F.when(F.col("g") != "-", F.expr("substring(g, instr(g, ':') + 1)"))
    tops = stored(inner.roots().select(F.lit("").alias("g"), F.col("g").alias("_group"), name.alias("_name"), "digest"))
    outer = grown(tops, [F.col("_name").asc_nulls_first()])
    root = outer.roots().select("g", F.array().cast(STEPS).alias("steps"), F.col("digest").alias("root"))
    groups = with_proofs(outer, paths(outer, root), ["_group"]).select(F.col("_group").alias("g"), F.col("proof").alias("steps"), F.col("digest").alias("subroot"), "root")
    found = with_proofs(inner, stored(paths(inner, stored(groups))), ["_key", *(f"_also_{n}" for n in also)])
    return found.select(F.col("_key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "proof", *(F.col(f"_also_{n}").alias(n) for n in also))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's hash and a proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        cut = 64 * step["at"]
        return F.sha2(F.concat(F.substring(step["others"], F.lit(1), cut), digest, F.substring(step["others"], cut + 1, F.length(step["others"]))), 256)

    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    """All hashes of a proof, one after another."""
    return F.array_join(F.transform(proof, lambda s: s["others"]), "")
