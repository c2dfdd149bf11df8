"""Byte-level BPE over a rank file.

Each pre-token (a match of the split pattern) is looked up whole in a minimal perfect hash of the
vocabulary; one that is no entry is merged from its bytes with a heap of neighbouring pairs over a linked
list. Results for pre-tokens are kept in a bounded table of each worker.

Null and empty texts give an empty list of ids. Characters that the pattern doesn't match are left out, as
the split leaves them out. A lone surrogate is encoded as U+FFFD.
"""

from __future__ import annotations

import base64
import re
import uuid
from array import array
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from tessera.llm import common
from tessera.llm.common import by_size, with_columns

KEPT = 600_000
#: Links of short pieces, to be copied.
SHORT = 64
NEXT, LAST = list(range(1, SHORT + 1)), list(range(-1, SHORT - 1))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass
class PerfectHash:
    """n keys in n slots. A key's bucket has a displacement that sends the bucket's keys to free slots; where
    a bucket has one key, -1 - slot."""

    displacement: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: list[bytes], values: list[int]) -> PerfectHash:
        n = len(keys)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(h)) != n:
            raise ValueError("two keys have the same 64-bit hash")
        buckets = max(1, n // 3)
        members: list[list[int]] = [[] for _ in range(buckets)]
        for k, b in enumerate((h % np.uint64(buckets)).tolist()):
            members[b].append(k)
        at, step = ((h >> np.uint64(20)) % np.uint64(max(n, 1))).tolist(), (h >> np.uint64(41)).tolist()
        free, slot, shift = bytearray(b"\1") * n, [0] * n, np.zeros(buckets, np.int64)
        spare = iter(range(n))
        for b in sorted(range(buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                for k in members[b]:
                    slot[k] = next(p for p in spare if free[p])
                    shift[b] = -1 - slot[k]
                continue
            d = 0
            while True:
                places = [(at[k] + d * step[k] + (d * d >> 3)) % n for k in members[b]]
                if len(set(places)) == len(places) and all(free[p] for p in places):
                    break
                d += 1
            shift[b] = d
            for k, p in zip(members[b], places, strict=True):
                slot[k], free[p] = p, 0
        check, value = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        check[slot], value[slot] = h, values
        return PerfectHash(shift, check, value)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key whose 64-bit hash is an entry's, else -1."""
        n = len(self.value)
        if not n:
            return np.full(len(keys), -1)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        d = self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)]
        place = (((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64) + d * (h >> np.uint64(41)).astype(np.int64) + (d * d >> 3)) % n
        place = np.where(d < 0, -1 - d, place)
        return np.where(self.check[place] == h, self.value[place], -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbouring pair of lowest rank, leftmost first, until no pair has a rank."""
    n, get = len(piece), ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    if n <= SHORT:
        after, before = NEXT[:n], LAST[:n]
    else:
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    # after and before: of the part that begins at a byte; after is also its end. own: its rank. pair: rank and place of it with the next one
    own, pair, heap = [ranks[piece[k : k + 1]] for k in range(n)], [-1] * n, []
    for k in range(n - 1):
        if (r := get(piece[k : k + 2])) is not None:
            pair[k] = x = r << shift | k
            heap.append(x)
    heapify(heap)
    while heap:
        x = heappop(heap)
        k = x & mask
        if pair[k] != x:
            continue  # one of the two parts has changed since
        own[k], mid = x >> shift, after[k]
        after[k] = end = after[mid]
        pair[mid] = -1
        if end < n:
            before[end] = k
            if (r := get(piece[k : after[end]])) is not None:
                pair[k] = x = r << shift | k
                heappush(heap, x)
            else:
                pair[k] = -1
        else:
            pair[k] = -1
        left = before[k]
        if left >= 0:
            if (r := get(piece[left:end])) is not None:
                pair[left] = x = r << shift | left
                heappush(heap, x)
            else:
                pair[left] = -1
    out, k = [], 0
    while k < n:
        out.append(own[k])
        k = after[k]
    return out


class Tokenizer:
    """Texts to ids, as bytes of 32-bit integers; ranks must hold all 256 single bytes.

    A text is cut before each space that follows something else than white space. No match of the split patterns in
    use spans such a cut or looks beyond it, so that a chunk, as a rule a word with what is attached to it,
    is split and encoded once and then kept, as is each pre-token. words: the pattern takes letters, with one space
    before them or none, as one match, so that such a chunk needs no split and is its own pre-token. What hasn't been met
    for a while makes room: of two tables, the older is dropped when the newer is full, and what it still serves is taken over.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole: PerfectHash, words: bool = True):
        self.ranks, self.whole, self.split = ranks, whole, regex.compile(pattern).findall
        self.words, self.parts = words, {v: k for k, v in ranks.items()}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def is_word(self, piece: str) -> bool:
        return self.words and (piece.isalpha() or piece[:1] == " " and piece[1:].isalpha())

    def merged(self, pieces: list[str], into: dict[str, bytes]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for piece, key, rank in zip(pieces, raw, self.whole.find(raw).tolist(), strict=True):
            # the hash finds the entry, its bytes confirm it
            ids = [rank] if rank >= 0 and self.parts[rank] == key else merge(key, self.ranks)
            into[piece] = array("i", ids).tobytes()

    def learn(self, new: set[str]) -> None:
        """Words are kept as chunks, other pre-tokens as pieces."""
        chunks, older, pieces = self.chunks, self.older, self.pieces
        known = {c for c in new if c in older}
        for c in known:
            chunks[c] = older[c]
        mixed = [c for c in new - known if not self.is_word(c)]
        found = [self.split(c) for c in mixed]
        parts = set().union(*found)
        words = {p for p in parts if self.is_word(p)}
        for p in words:
            if p in older and p not in chunks:
                chunks[p] = older[p]
        self.merged([*((new - known).difference(mixed) | words).difference(chunks)], chunks)
        self.merged([*(parts - words).difference(pieces)], pieces)
        for chunk, own in zip(mixed, found, strict=True):
            chunks[chunk] = b"".join([chunks[p] if p in words else pieces[p] for p in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for a, b in by_size(texts, 400_000):
            if len(self.chunks) > KEPT // 2:
                self.older, self.chunks = self.chunks, {}
            if len(self.pieces) > KEPT // 16:
                self.pieces = {}
            cut = [chunked(t) for t in texts[a:b]]
            if new := set().union(*cut).difference(self.chunks):
                self.learn(new)
            get = self.chunks.__getitem__
            out += [b"".join(map(get, x)) for x in cut]
        return out


def live(call: str, ranks: dict[bytes, int], pattern: str, whole: PerfectHash) -> Tokenizer:
    """The tokenizer of a worker's last task, if it belongs to the same call: the next task goes on with its tables."""
    return common.live(call, lambda: Tokenizer(ranks, pattern, whole))


def chunked(text: str) -> list[str]:
    """Chunks that give the text end to end."""
    if SPACES(text):
        return CUT(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


SPACES = re.compile(r"\s ").search
CUT = re.compile(r"(?<=\S)(?= )").split


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", whole_texts: int = 256) -> DataFrame:
    """df with a column of token ids (array<int>) for each text."""
    whole, call = PerfectHash.build(list(ranks), list(ranks.values())), uuid.uuid4().hex

    def make():
        tokenizer = live(call, ranks, pattern, whole)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = tokenizer.encode([t or "" for t in batch.column(text).to_pylist()])
            offsets = (np.cumsum([0, *map(len, found)]) // 4).astype(np.int32)
            flat = np.frombuffer(b"".join(found), np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

        return work

    return with_columns(df, f"`{ids}` array<int>", make, whole_texts, call)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column: the bytes of the ids, end to end. Null ids give no bytes; an unknown id is an error."""
    size = max(ranks.values(), default=-1) + 1

    def make():
        length = np.full(size, -1)
        for piece, rank in ranks.items():
            length[rank] = len(piece)
        begin = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
        letters = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

        def bytes_of(part: np.ndarray) -> bytes:
            n = length[part]
            if len(part) and (part.min() < 0 or n.min() < 0):
                raise ValueError("an id has no entry")
            return letters[np.arange(n.sum()) + np.repeat(begin[part] - np.cumsum(n) + n, n)].tobytes()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([bytes_of(x.values.to_numpy()) if x.is_valid else b"" for x in batch.column(ids)], pa.binary())]

        return work

    return with_columns(df, f"`{out}` binary", make, 256)
