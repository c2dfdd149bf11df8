"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph (a line, ASCII white space at its ends left off; empty ones don't count) adds a wide vector of 32-bit values
that its hashes choose, and vectors are summed modulo 2^32. So the order of paragraphs doesn't matter, a paragraph can be
added or taken away without the rest (`add`, `subtract`), and texts with equal multisets have equal fingerprints.

Every paragraph adds to each of the first `CHECKS` lanes. The others are `LEVELS` levels of `LANES` lanes: of a level, one
lane gets a value from each paragraph that belongs to it, all of them at first, then a quarter of those before.
Likeness counts lanes at the first level that isn't crowded, so that it works for texts of a few paragraphs and of many
thousands: of 32 lanes, d different ones and u used ones stand for 32 ln(32 / (32 - d)) different paragraphs and as many
used ones; likeness is the share of those that are the same, an estimate of the Jaccard similarity.

Null and empty texts, and white space alone, have the zero fingerprint; two of them are alike (1.0).
All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

CHECKS, LEVELS, LANES = 4, 7, 32
MODULUS = 1 << 32
#: A level of more used lanes than this is crowded.
CROWDED = 24
WHITE = " \t\r\x0b\x0c"


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.btrim(p, F.lit(WHITE))), lambda p: p != "")


def lanes(text: Column) -> Column:
    """array<long> of CHECKS + LEVELS * LANES sums."""

    def entry(p: Column) -> Column:
        h, v, w = F.xxhash64(p), F.xxhash64(p, F.lit(1)), F.xxhash64(p, F.lit(2))
        low = lambda x: x.bitwiseAND(MODULUS - 1)
        return F.struct(h.alias("at"), low(v).alias("v"), F.array(low(h), F.shiftrightunsigned(v, 32), low(w), F.shiftrightunsigned(w, 32)).alias("checks"), w.alias("level"))

    zero = F.lit(0).cast("long")

    def level_sums(entries: Column, level: int) -> Column:
        own = F.filter(entries, lambda e: e["level"].bitwiseAND((1 << 2 * level) - 1) == 0) if level else entries

        def put(sums: Column, e: Column) -> Column:
            at = F.shiftrightunsigned(e["at"], 5 * level + 20).bitwiseAND(LANES - 1)
            return F.transform(sums, lambda s, i: (s + F.when(i == at, e["v"]).otherwise(zero)) % MODULUS)

        return F.aggregate(own, F.array_repeat(zero, LANES), put)

    def summed(entries: Column) -> Column:
        checks = F.aggregate(entries, F.array_repeat(zero, CHECKS), lambda sums, e: F.zip_with(sums, e["checks"], lambda s, x: (s + x) % MODULUS))
        return F.concat(checks, *(level_sums(entries, level) for level in range(LEVELS)))

    # the array of one makes the entries once for all sums
    return F.get(F.transform(F.array(F.transform(paragraphs(text), entry)), summed), F.lit(0))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y) % MODULUS)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a without the paragraphs of b."""
    return F.zip_with(a, b, lambda x, y: (x - y + MODULUS) % MODULUS)


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of the paragraphs of either that both have; 1.0 for equal fingerprints."""
    pairs = F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), CHECKS + 1, LEVELS * LANES)

    def level(k: Column) -> Column:
        lanes_ = F.slice(pairs, k * LANES + 1, F.lit(LANES))
        return F.struct(F.size(F.filter(lanes_, lambda p: (p["x"] != 0) | (p["y"] != 0))).alias("used"), F.size(F.filter(lanes_, lambda p: p["x"] != p["y"])).alias("unlike"))

    used = F.filter(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level), lambda x: x["used"] > 0)
    free = F.filter(used, lambda x: x["used"] <= CROWDED)
    counted = lambda n: -F.log(1 - F.least(n, F.lit(LANES - 0.5)) / LANES)
    guess = F.transform(F.array(F.coalesce(F.get(free, F.lit(0)), F.element_at(used, -1))), lambda x: F.greatest(F.lit(0.0), 1 - counted(x["unlike"]) / counted(x["used"])))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.get(guess, F.lit(0)), F.lit(0.0)))


def as_hex(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


#: A place in the order: null keys last, the others descending, equal ones by the hash of the text.
PLACE = ("_null", "_k", "_h")


def in_order() -> list[Column]:
    return [F.asc("_null"), F.desc("_k"), F.asc("_h")]


def receivers(places: DataFrame) -> DataFrame:
    """places (PLACE, distinct, and others) with _to: the columns of the place before it; of the last one for the first.

    Places are dealt to ranges; a window runs within each, and one over the ranges' last places, a row for each range.
    """
    placed = stored(places.repartitionByRange(*in_order()).withColumn("_p", F.spark_partition_id()))
    here = F.struct(*places.columns)
    ends = placed.groupBy("_p").agg(F.max_by(here, F.struct("_null", F.bitwise_not("_k"), "_h")).alias("_end"))
    by_range = Window.orderBy("_p")  # one row for each range
    every = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ends.select("_p", F.coalesce(F.lag("_end").over(by_range), F.last("_end").over(every)).alias("_before"))
    within = Window.partitionBy("_p").orderBy(*in_order())
    return placed.join(F.broadcast(before), "_p").withColumn("_to", F.coalesce(F.lag(here).over(within), "_before")).drop("_p", "_before")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, head and next_lanes for every row: of the next document by descending key (after the last: the first), the
    first floor(n / 2) code points, n being the row's own length, and the lanes of its whole text.

    Rows of one key (a whole number) are in order of their texts' hashes, null keys come last; rows that repeat key and text
    share a place. Only a table of keys, hashes and lengths is put in order; texts meet by joins on places, the next one's
    cut to what is needed.
    """
    place = F.col(key).isNull().alias("_null"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h")
    rows = docs.select(*place, F.coalesce(text, F.lit("")).alias(text))  # no more columns: both joins read one exchange
    to = receivers(rows.select(*PLACE, F.floor(F.length(text) / 2).cast("int").alias("_half")).distinct()).select(*PLACE, "_to")
    sent = rows.join(to.hint("merge"), list(PLACE)).select(*(F.col(f"_to.{c}").alias(c) for c in PLACE), F.substring(text, F.lit(1), F.col("_to._half")).alias("head"), lanes(F.col(text)).alias("next_lanes"))
    found = rows.join(sent.dropDuplicates(list(PLACE)).hint("merge"), list(PLACE))
    return found.select(F.when(~F.col("_null"), F.col("_k")).cast(docs.schema[key].dataType).alias(key), text, "head", "next_lanes")
