"""Repeats of `MATCH` bytes or more across documents, by suffix arrays of shards.

Every window of MATCH bytes has an anchor, the gram of GRAM bytes in it with the least hash, common grams after all others.
Equal windows have equal anchors, so only anchors that occur in two documents or more can belong to a repeat. Their contexts
(the bytes of the windows whose anchor they are) are dealt to shards of about `SHARD` contexts, neighbours in the order of the
anchors' hashes. Each shard sorts the suffixes of its different contexts by Larsson and Sadakane's refinement (groups of equal
prefixes are split by the ranks further on, and the prefix doubles), takes common prefixes of neighbours by Kasai's walk, and
so finds which windows are equal, and the smallest document of each. A window is a repeat if that document is smaller.

An anchor can have more contexts than a shard: then it is in several, and what a shard leaves undecided of it, its sorted
different windows and their smallest documents, is merged with the others' by binary search.

Byte positions are those of the UTF-8 text. Matches never cross documents, nor count within one; documents that are
copies of a smaller one as a whole are told by their digests beforehand. Null and empty texts and those shorter than MATCH
have no repeats. Rows of equal ids aren't smaller than one another; rows without an id have no repeats and are nobody's original.
Of other columns none is read or returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, sampled

MATCH, GRAM = 50, 20
#: Grams in a window.
GRAMS = MATCH - GRAM + 1
#: Contexts in a shard; bytes of text in a slice of a task; bytes of text for each bucket of anchors.
SHARD, SLICE, BUCKET = 16_384, 1 << 23, 20_000_000
#: An anchor that occurs more often than this in a slice is dealt to shards from there.
OFTEN = 256
#: The contexts of such an anchor from so many slices go to one shard.
SLICES = 8
#: Grams of COMMON texts or more out of a sample of about SAMPLE are common ones, COMMONEST at most. Any choice gives the
#: same repeats; it keeps phrases that many texts share from being anchors of texts that are otherwise unlike.
SAMPLE, COMMON, COMMONEST = 4096, 8, 200_000
#: Bytes of suffixes that are sorted at once: more than SHARD contexts have.
SORTED = 1 << 21

Array = np.ndarray


def binary(column: pa.Array) -> tuple[Array, Array]:
    """Bytes and ends of an Arrow array of texts; nulls are empty."""
    whole = pa.concat_arrays([column.fill_null("")]) if column.null_count else column
    cut = np.frombuffer(whole.buffers()[1], np.int64 if pa.types.is_large_string(whole.type) else np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    held = whole.buffers()[2]
    data = np.frombuffer(held, np.uint8)[cut[0] : cut[-1]] if held is not None and len(whole) else np.zeros(0, np.uint8)
    return data, cut[1:] - cut[0] if len(whole) else np.zeros(0, np.int64)


def slices(ends: Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most `limit` bytes, or one longer text."""
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def words(data: Array) -> Array:
    """The eight bytes from each position, as a number; positions with fewer are left out."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for k in range(min(8, max(n, 0))):
        part = data[k : k + (n - k + 7) // 8 * 8].view("<u8")
        out[k::8] = part
    return out


def grams(data: Array) -> Array:
    """A hash of the GRAM bytes from each position."""
    w, n = words(data), len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15) + w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + w[GRAM - 8 : n + GRAM - 8] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def common_grams(docs: DataFrame, total: int, sample: int = SAMPLE, least: int = COMMON) -> Array:
    """Sorted hashes of the common grams; docs: text, mark; total: rows of docs."""

    def count(batches):
        for batch in batches:
            data, ends = binary(batch.column("text"))
            for a, b in slices(ends):
                start = ends[a - 1] if a else 0
                if ends[b - 1] - start < GRAM:
                    continue
                h = grams(data[start : ends[b - 1]])
                kinds, n = np.unique(h, return_counts=True)
                kept = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(kinds[kept].view(np.int64)), pa.array(n[kept], pa.int64())], ["gram", "n"])

    part = docs.filter(sampled(F.col("mark"), min(1.0, sample / max(total, 1)), 5)).select("text").distinct()
    counts = part.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "gram").limit(COMMONEST).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def anchors(data: Array, ends: Array, common: Array | None = None, block: int = 1 << 15) -> tuple[Array, Array, Array, Array]:
    """place, hash, first window and number of windows of every anchor of the texts, in order. common: hashes, sorted."""
    if common is not None and len(common):
        may = np.zeros(1 << 22, bool)
        may[(common >> np.uint64(42)).astype(np.int64)] = True
    n = len(data) - MATCH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    late, found = np.maximum(starts, ends - MATCH + 1), []  # from there on windows go over their text's end
    for low in range(0, n, block):
        high = min(low + block, n)
        h = grams(data[low : high + MATCH - 1])
        # hash and place in one number: of equal hashes the first is the least
        least = (h >> np.uint64(1) & ~np.uint64(0x1FFFF)) | np.arange(len(h), dtype=np.uint64)
        if common is not None and len(common):
            maybe = np.flatnonzero(may[(h >> np.uint64(42)).view(np.int64)])
            found_ = common[np.minimum(np.searchsorted(common, h[maybe]), len(common) - 1)] == h[maybe]
            least[maybe[found_]] |= np.uint64(1 << 63)
        width = 1
        while 2 * width <= GRAMS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := GRAMS - width:
            least = np.minimum(least[:-rest], least[rest:])
        some = slice(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(late, high)))
        step = np.zeros(high - low + 1, np.int32)
        np.add.at(step, np.clip(late[some] - low, 0, high - low), 1)
        np.add.at(step, np.clip(ends[some] - low, 0, high - low), -1)
        at = np.flatnonzero(np.cumsum(step[:-1]) == 0)
        if not len(at):
            continue
        place = (least[at] & np.uint64(0x1FFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
        found.append((place[new] + low, h[place[new]], at[new] + low, np.diff(np.append(new, len(at)))))
    if not found:
        return anchors(data[:0], ends[:0])
    place, key, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # one can go on in the next block
    return place[new], key[new], first[new], np.add.reduceat(count, new)


def planes(numbers: Array, width: int) -> bytes:
    """The low `width` bytes of the numbers, all first bytes first: those that are mostly zero compress well."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(held: Array, width: int) -> Array:
    part = held.reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.view("<u8").ravel()


def lists(values: Array, cuts: Array, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def changes(*sorted_: Array) -> Array:
    """Where a run of equal values begins."""
    n = len(sorted_[0])
    if not n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([a[1:] != a[:-1] for a in sorted_], axis=0)]))


BLOCKS = "bucket long, keys binary, at binary, texts binary, ids array<long>, marks array<long>, wanted array<long>, shards array<long>"
REPLIES = "doc_id long, mark long, at array<long>, shards array<long>"


def replies(doc: Array, mark: Array, at: Array, shard: Array) -> list[pa.Array]:
    """The columns of REPLIES: a row for each text."""
    order = np.lexsort((at, mark, doc))
    doc, mark, at, shard = doc[order], mark[order], at[order], shard[order]
    new = changes(doc, mark)
    cuts = np.append(new, len(doc))
    return [pa.array(doc[new], pa.int64()), pa.array(mark[new], pa.int64()), lists(at, cuts, pa.int64()), lists(shard, cuts, pa.int64())]


def blocks(docs: DataFrame, common: Broadcast, buckets: int, shards: int, groups: int, often_: int = OFTEN, limit: int = SLICE) -> DataFrame:
    """Anchors of the texts by bucket, packed: sorted 40-bit hashes, places and texts. Of anchors that occur often in a slice,
    a hash without a text, and a row (bucket null) of texts, places and shards, for each slice."""
    names = ["bucket", "keys", "at", "texts", "ids", "marks", "wanted", "shards"]

    def work(batches):
        for batch in batches:
            data, ends = binary(batch.column("text"))
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
            for a, b in slices(ends, limit):
                start = ends[a - 1] if a else 0
                place, key, _, _ = anchors(data[start : ends[b - 1]], ends[a:b] - start, common.value)
                if len(place):
                    yield from packed(place, key, ends[a:b] - start, ids[a:b], marks[a:b])
        release()

    def packed(place, key, ends, ids, marks):
        order = np.argsort(key)
        place, key = place[order], key[order]
        text = np.searchsorted(ends, place, "right")
        at = place - np.where(text > 0, ends[text - 1], 0)
        new = changes(key)
        times = np.diff(np.append(new, len(key)))
        often = np.repeat(times > often_, times)
        if often.any():
            salt = np.array([ids[0]]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            salt = salt % np.uint64(groups) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed = (key[often] ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            shard = -1 - ((mixed >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)  # below zero, beside the others
            doc, mark, where, to = replies(ids[text[often]], marks[text[often]], at[often], shard << 1 | 1)
            none, each = pa.nulls(len(doc), pa.binary()), np.arange(len(doc) + 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), none, none, none, *(lists(x.to_numpy(), each, pa.int64()) for x in (doc, mark)), where, to], names)
        told = np.concatenate([np.flatnonzero(~often), new[times > often_]])
        told.sort()
        bucket = ((key[told] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        new = changes(bucket)
        columns = [[] for _ in names]
        for low, high in zip(new, np.append(new[1:], len(told)), strict=True):
            rows = told[low:high]
            short = key[rows] & np.uint64((1 << 40) - 1)
            used, local = np.unique(text[rows], return_inverse=True)
            local = np.where(often[rows], len(used), local)  # one more than the last: no text, but often
            delta = np.diff(short, prepend=np.uint64(0)) & np.uint64((1 << 40) - 1)
            for c, v in zip(columns, (int(bucket[low]), planes(delta, 5), planes(at[rows], 5), planes(local, 3), ids[used].tolist(), marks[used].tolist(), None, None), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(work, BLOCKS)


def pieces_of(column: pa.Array, kind: type) -> list[Array]:
    """The values of an array of lists or bytes, as views."""
    cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = column.values.to_numpy() if pa.types.is_list(column.type) else np.frombuffer(column.buffers()[2] or b"", kind)
    return [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def shared(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[pa.RecordBatch]:
    """REPLIES for the anchors of whole buckets that two documents or more have, with their shards: twice its number, and one
    more if the anchor is in several."""
    held: dict[int, list] = {}
    for batch in batches:
        ready = batch.filter(batch.column("bucket").is_null())
        if ready.num_rows:
            flat = [ready.column(c).flatten() for c in ("ids", "marks")]
            yield pa.RecordBatch.from_arrays([*flat, ready.column("wanted"), ready.column("shards")], ["doc_id", "mark", "at", "shards"])
        rows = batch.filter(batch.column("bucket").is_valid())
        views = [pieces_of(rows.column(c), kind) for c, kind in (("keys", np.uint8), ("at", np.uint8), ("texts", np.uint8), ("ids", np.int64), ("marks", np.int64))]
        for bucket, *parts in zip(rows.column("bucket").to_pylist(), *views, strict=True):
            held.setdefault(bucket, []).append(dict(zip(("keys", "at", "texts", "ids", "marks"), parts, strict=True)))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        # first the hashes alone: most are there once
        key = np.concatenate([np.cumsum(from_planes(r["keys"], 5)) & np.uint64((1 << 40) - 1) for r in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        again = key[1:] == key[:-1]
        order, key = (x[np.concatenate([again, [False]]) | np.concatenate([[False], again])] for x in (order, key))
        if not len(key):
            continue
        ends, place = np.cumsum([len(r["keys"]) // 5 for r in parts]), np.zeros(len(key), np.int64)
        doc, mark, often = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        of = np.searchsorted(ends, order, "right")
        for k, r in enumerate(parts):
            own = np.flatnonzero(of == k)
            rows = order[own] - (ends[k - 1] if k else 0)
            local = from_planes(r["texts"], 3)[rows].astype(np.int64)
            place[own] = from_planes(r["at"], 5)[rows]
            often[own] = local == len(r["ids"])
            doc[own], mark[own] = (np.append(r[c], 0)[local] for c in ("ids", "marks"))
        new = changes(key)
        times = np.diff(np.append(new, len(key)))
        many = np.logical_or.reduceat(often, new)
        two = (np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)) | many
        kept = np.flatnonzero(np.repeat(two, times) & ~often)
        if not len(kept):
            continue
        at, group, turn = place, np.repeat(np.arange(len(new)), times)[kept], np.arange(len(kept)) // size
        first = changes(group)
        last = np.append(first[1:], len(group)) - 1
        several = np.repeat((turn[first] != turn[last]) | many[group[first]], last - first + 1)
        columns = replies(doc[kept], mark[kept], at[kept], (bucket << 24 | turn) << 1 | several)
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "at", "shards"])
    release()


CONTEXTS = "shard long, docs array<long>, marks array<long>, starts array<long>, counts array<long>, several array<boolean>, size long, bytes binary"


def ranges(starts: Array, lengths: Array) -> Array:
    """The numbers of all ranges, one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


def contexts(batches: Iterator[pa.RecordBatch], common: Broadcast) -> Iterator[pa.RecordBatch]:
    """doc_id, mark, text, at, shards (lists): the contexts of the anchors, packed by shard."""
    zstd = pa.Codec("zstd")
    for batch in batches:
        data, ends = binary(batch.column("text"))
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
        of = batch.column("at").offsets.to_numpy().astype(np.int64)
        at, shard = (batch.column(c).values.to_numpy() for c in ("at", "shards"))
        for a, b in slices(ends):
            start = ends[a - 1] if a else 0
            place, _, first, count = anchors(data[start : ends[b - 1]], ends[a:b] - start, common.value)
            text = np.repeat(np.arange(b - a), np.diff(of[a : b + 1]))
            base = np.concatenate([[0], ends[a : b - 1] - start])
            wanted, to = at[of[a] : of[b]] + base[text], shard[of[a] : of[b]]
            k = np.searchsorted(place, wanted)
            order = np.argsort(to >> 1, kind="stable")
            k, to, text = k[order], to[order], text[order]
            new = changes(to >> 1)
            cuts = np.append(new, len(to))
            lengths = count[k] + MATCH - 1
            size = np.concatenate([[0], np.cumsum(lengths)])[cuts]
            held = np.concatenate([data[start:][ranges(first[k][p : p + 50_000], lengths[p : p + 50_000])] for p in range(0, len(k), 50_000)])
            texts = [zstd.compress(held[x:y], asbytes=True) for x, y in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            columns = [pa.array(to[new] >> 1, pa.int64()), *(lists(x, cuts, pa.int64()) for x in (ids[a:b][text], marks[a:b][text], first[k] - base[text], count[k])), lists((to & 1).astype(bool), cuts, pa.bool_()), pa.array(np.diff(size)), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "docs", "marks", "starts", "counts", "several", "size", "bytes"])
    release()


def suffix_array(text: Array, wanted: Array) -> Array:
    """The wanted positions, in the order of the MATCH bytes from each (zeros beyond the end). For texts of under 2^31 bytes.

    Sorted by five bytes at first; then groups that are still equal are split by the rank of what follows, until MATCH
    bytes are told apart. Suffixes whose order no wanted one depends on are left as they are.
    """
    n = len(text)
    bits = max(1, n.bit_length())
    tail = np.concatenate([text, np.zeros(MATCH + 8, np.uint8)])
    plan = [5, 10, 20, 10]  # prefixes of 5, 10, 20 and 40 bytes, and 10 more
    needs = [wanted]
    for h in reversed(plan):
        last = needs[-1]
        more = last.copy()
        more[h:] |= last[:-h]
        needs.append(more)
    needs.reverse()
    at = np.flatnonzero(needs[0])
    five = words(tail)[at].byteswap() >> np.uint64(24)
    order = np.argsort(five)
    sa, five = at[order], five[order]
    rank = np.zeros(n + MATCH, np.int64)
    starts = changes(five)
    sizes = np.diff(np.append(starts, len(sa)))
    rank[sa] = np.repeat(starts, sizes) + 1  # zero: beyond the end
    for h, need in zip(plan, needs[1:], strict=True):
        slot = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(slot):
            break
        who = sa[slot]
        mine = need[who]  # the others of a group go first, in any order
        key = rank[who] << bits | np.where(mine, rank[who + h], 0)
        order = np.argsort(key)
        who, key = who[order], key[order]
        sa[slot] = who
        new = changes(key)
        rank[who] = np.repeat(slot[new], np.diff(np.append(new, len(who)))) + 1
        starts = changes(rank[sa])
        sizes = np.diff(np.append(starts, len(sa)))
    return sa[wanted[sa]]


def common_prefixes(text: Array, sa: Array, wanted: Array, low: Array, counts: Array) -> Array:
    """Of each position in sa, the bytes (MATCH at most) it shares with the one before it, by Kasai's walk.

    Wanted positions come in runs (from low, so many); all runs are walked at once, a position of each at a time. Where
    the suffix before has a wanted one after it, which is earlier in sa than the next position, all but one of the common
    bytes still hold.
    """
    w = words(np.concatenate([text, np.zeros(MATCH + 16, np.uint8)]))
    before, place = np.full(len(text) + 1, -1), np.full(len(text) + 1, len(sa))
    before[sa[1:]], place[sa] = sa[:-1], np.arange(len(sa))
    out, known = np.zeros(len(text) + 1, np.int64), np.zeros(len(low), np.int64)
    for t in range(int(counts.max(initial=0))):
        lane = np.flatnonzero(counts > t)
        i = low[lane] + t
        j = before[i]
        if t:
            last = before[i - 1]
            holds = (last >= 0) & wanted[np.minimum(last + 1, len(text) - 1)] & (place[last + 1] < place[i])
            same = np.where(holds, np.maximum(known[lane] - 1, 0), 0)
        else:
            same = np.zeros(len(lane), np.int64)
        going = np.flatnonzero(j >= 0)
        while len(going):
            unlike = w[i[going] + same[going]] ^ w[j[going] + same[going]]
            more = np.where(unlike == 0, 8, np.bitwise_count((unlike & (~unlike + np.uint64(1))) - np.uint64(1)) // 8)
            same[going] = np.minimum(same[going] + more, MATCH)
            going = going[(more == 8) & (same[going] < MATCH)]
        known[lane] = same
        out[i] = same
    return out[sa]


FOUND = "to long, doc_id long, mark long, start long, n long, shard long, window binary"
NAMES = ["to", "doc_id", "mark", "start", "n", "shard", "window"]


def settle(shard: pa.Table) -> pa.Table:
    """Of one shard: runs of n windows (from start) that a smaller document has; and, of anchors that are in several shards,
    the windows that no smaller document of this shard has."""
    rows = shard.combine_chunks()
    doc, mark, start, n, several = (rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("docs", "marks", "starts", "counts", "several"))
    zstd = pa.Codec("zstd")
    parts = [zstd.decompress(b, int(z), asbytes=True) for b, z in zip(rows.column("bytes").to_pylist(), rows.column("size").to_pylist(), strict=True)]
    return pa.concat_tables(settled(doc, mark, start, n, several, np.frombuffer(b"".join(parts), np.uint8), rows.column("shard")[0].as_py()))


def settled(doc: Array, mark: Array, start: Array, n: Array, several: Array, held: Array, number: int) -> list[pa.Table]:
    """settle() of contexts of n windows each, end to end in held."""
    lengths = n + MATCH - 1
    low = np.cumsum(lengths) - lengths
    # equal contexts are one, with its smallest document
    wide = np.zeros((len(n), MATCH + GRAMS), np.uint8)
    wide[np.repeat(np.arange(len(n)), lengths), np.arange(len(held)) - np.repeat(low, lengths)] = held
    wide[:, -1] = n
    _, one, kind = np.unique(wide.view(f"V{wide.shape[1]}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc)
    edge = np.zeros(len(one), bool)
    np.logical_or.at(edge, kind, several)
    copies = np.flatnonzero(doc > least[kind])
    out = [table(doc[copies], mark[copies], start[copies], n[copies])]
    # windows of the different contexts; in parts that are sorted one by one if there are too many bytes
    counts = n[one]
    size = counts + MATCH - 1
    text = held[ranges(low[one], size)]
    base = np.cumsum(size) - size
    place, again = np.zeros(len(text), np.int64), np.zeros(len(text), bool)
    parts = list(slices(base + size, SORTED))
    edge |= len(parts) > 1
    for a, b in parts:
        begin, end = base[a], base[b - 1] + size[b - 1]
        own = text[begin:end]
        wanted = np.zeros(len(own), bool)
        wanted[ranges(base[a:b] - begin, counts[a:b])] = True
        owner = np.repeat(np.arange(a, b), size[a:b])
        sa = suffix_array(own, wanted)
        first = np.flatnonzero(common_prefixes(own, sa, wanted, base[a:b] - begin, counts[a:b]) < MATCH)
        smallest = np.minimum.reduceat(least[owner[sa]], first)
        again[begin + sa] = np.repeat(smallest, np.diff(np.append(first, len(sa)))) < least[owner[sa]]
        place[begin + sa] = np.arange(len(sa)) + begin
    # rows of the contexts' smallest documents: runs of repeats
    keep = np.flatnonzero(doc == least[kind])
    row = np.repeat(keep, n[keep])
    window = ranges(base[kind[keep]], n[keep])
    hit = np.flatnonzero(again[window])
    offset = window[hit] - base[kind[row[hit]]]
    new = np.flatnonzero(np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(hit) else hit
    own = row[hit][new]
    out.append(table(doc[own], mark[own], start[own] + offset[new], np.diff(np.append(new, len(hit)))))
    left = np.flatnonzero(~again[window] & edge[kind[row]])
    if len(left):
        left = left[np.argsort(place[window[left]], kind="stable")]  # a sorted list of windows
        bytes_ = text[window[left][:, None] + np.arange(MATCH)]
        eights = np.ascontiguousarray(np.pad(bytes_, ((0, 0), (0, -MATCH % 8)))).view("<u8")
        key = np.zeros(len(left), np.uint64)
        for part in eights.T:
            key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
        own = row[left]
        out.append(table(doc[own], mark[own], start[own] + window[left] - base[kind[own]], np.ones(len(left), np.int64), key.view(np.int64), number, bytes_))
    return out


def table(doc: Array, mark: Array, start: Array, n: Array, to: Array | None = None, number: int | None = None, windows: Array | None = None) -> pa.Table:
    kept = pa.nulls(len(doc), pa.binary()) if windows is None else pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((np.arange(len(doc) + 1) * MATCH).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(windows))])
    shard = pa.nulls(len(doc), pa.int64()) if number is None else pa.array(np.full(len(doc), number), pa.int64())
    return pa.table([*(pa.array(x, pa.int64()) for x in (doc if to is None else to, doc, mark, start, n)), shard, kept], NAMES)


def merged(a: tuple[Array, Array], b: tuple[Array, Array]) -> tuple[Array, Array]:
    """Two sorted lists of different windows and their smallest documents as one, by binary search."""
    at = np.searchsorted(a[0], b[0])
    same = np.zeros(len(at), bool)
    inside = at < len(a[0])
    same[inside] = a[0][at[inside]] == b[0][inside]
    least = a[1].copy()
    least[at[same]] = np.minimum(least[at[same]], b[1][same])
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(least, at[~same], b[1][~same])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND without the windows of several shards: of those, the ones that another shard has of a smaller document."""
    held = []
    for batch in batches:
        settled_ = batch.filter(batch.column("window").is_null())
        if settled_.num_rows:
            yield settled_.select(["doc_id", "mark", "start", "n"])
        if settled_.num_rows < batch.num_rows:
            held.append(batch.filter(batch.column("window").is_valid()))
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    doc, mark, start, n, shard = (rows.column(c).to_numpy() for c in ("doc_id", "mark", "start", "n", "shard"))
    window = np.array(rows.column("window").to_pylist(), f"S{MATCH}")
    order = np.lexsort((window, shard))
    new = changes(shard[order])
    sorted_ = []
    for low, high in zip(new, np.append(new[1:], len(order)), strict=True):
        own = order[low:high]
        first = changes(window[own])
        sorted_.append((window[own][first], np.minimum.reduceat(doc[own], first)))
    while len(sorted_) > 1:
        sorted_ = [merged(*sorted_[k : k + 2]) if k + 1 < len(sorted_) else sorted_[k] for k in range(0, len(sorted_), 2)]
    hit = np.flatnonzero(sorted_[0][1][np.searchsorted(sorted_[0][0], window)] < doc)
    yield pa.RecordBatch.from_arrays([pa.array(x[hit], pa.int64()) for x in (doc, mark, start, n)], ["doc_id", "mark", "start", "n"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, spans and kept from doc_id, text and runs."""
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices(binary(whole.column("text"))[1], SLICE // 8)):
        data, ends = binary(batch.column("text"))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        runs = batch.column("runs")
        parts = runs.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = runs.flatten()
        row = np.repeat(np.arange(len(parts)), parts)
        begin = flat.field("start").to_numpy() + starts[row] if len(row) else np.zeros(0, np.int64)
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + (flat.field("n").to_numpy() + MATCH - 1 if len(row) else 0), -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        # spans end with their text
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = edge[starts] = True
        here = gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])) if len(data) else gone
        past = gone & (edge[1:] | ~np.concatenate([gone[1:], [False]])) if len(data) else gone
        low, high = np.flatnonzero(here), np.flatnonzero(past) + 1
        text = np.searchsorted(ends, low, "right")
        count = np.bincount(text, minlength=len(ends)) if len(ends) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(low - starts[text], pa.int64()), pa.array(high - starts[text], pa.int64())], ["start", "end"])
        left = np.concatenate([[0], np.cumsum(~gone)])[np.concatenate([[0], ends])] if len(ends) else np.zeros(1, np.int64)
        kept = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        cuts = np.concatenate([[0], np.cumsum(count)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends - starts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), kept.cast(pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, shard: int = SHARD, often: int = OFTEN, limit: int = SLICE, sample: int = SAMPLE, least: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, spans (start, end: the bytes that repeat a smaller document, as maximal runs) and kept (the other
    bytes, one after another) of every row. docs: doc_id, text. The others: sizes of the work,
    see above; the result is the same for any."""
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(key, text.alias("text"), F.xxhash64(text).alias("mark"))
    # rows have a mark of their text, since an id may repeat; all uses of the texts below read one exchange
    held = rows.filter("doc_id is not null")
    number, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    common = docs.sparkSession.sparkContext.broadcast(common_grams(rows, number, sample, least))
    buckets, shards = max(12, total // BUCKET), max(12, total // (shard * 60))
    sized = held.select("doc_id", "mark", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest")).filter(F.col("size") >= MATCH)
    firsts = sized.groupBy("digest").agg(F.min("doc_id").alias("first"))
    later = sized.join(firsts, "digest").filter("doc_id > first").select("doc_id", "mark", "size").distinct()
    every = later.select("doc_id", "mark")
    own = held.join(every, ["doc_id", "mark"], "left_anti")
    asked = blocks(own.select("doc_id", "text", "mark"), common, buckets, shards, max(1, total // (SLICES * limit)), often, limit).repartitionById(buckets, F.coalesce("bucket", F.pmod(F.xxhash64("ids"), F.lit(buckets))).cast("int")).mapInArrow(partial(shared, size=shard), REPLIES)
    asked = asked.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("shards")).alias("shards"))
    near = held.join(asked, ["doc_id", "mark"]).select("doc_id", "text", "mark", "at", "shards").mapInArrow(partial(contexts, common=common), CONTEXTS)
    found = near.groupBy("shard").applyInArrow(settle, FOUND).repartition("to").mapInArrow(merge, "doc_id long, mark long, start long, n long")
    copies = later.select("doc_id", "mark", F.lit(0).cast("long").alias("start"), (F.col("size") - (MATCH - 1)).cast("long").alias("n"))
    runs = found.union(copies).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    told = held.join(runs, ["doc_id", "mark"], "left").select("doc_id", "text", "runs")
    told = told.union(rows.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType)))
    return told.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
